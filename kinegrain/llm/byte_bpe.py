"""Byte-level BPE by a file of ranks: texts to ids with offsets, and ids back to bytes and text.

The tokenizers library encodes. Its model needs characters and merges, the file has bytes
and ranks: bytes stand as characters by the usual byte table, and the merge behind a token is
the pair that the lower ranks leave of its bytes. ``ignore_merges`` takes a piece that is a
token whole, as ranks do. The model is built on the driver and broadcast: its size is the
rank file's, whatever the input's. Each worker opens it once and encodes each distinct piece
of its Arrow batches once, in runs of about 4 MB of text.

Decoding turns ids to the library's characters and those to bytes by the reversed table. A
token may hold a part of a character only: ``char_ends`` counts the characters that are whole
at a token's end, so that a split character belongs to the token that completes it, and
``decoded_text`` replaces what is cut off at either end of a run of ids.

Defined cases: null and empty texts have no ids and decode to no bytes; null ids decode to
null; ids without a token decode to nothing; invalid UTF-8 is made valid first; equal rows
and null doc_ids are rows like others; empty tables give empty results. Own columns replace
input columns of the same name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .token_output import _Coder, _runs

#: The split that token_output.PIECES expresses, as users of such rank files state it; a fixed value.
USUAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that an encoding worker remembers; a task has a decoding worker besides.
MEMO = 1 << 18
#: Tokens decoded at a time.
DECODE_TOGETHER = 1 << 20

_OPEN: dict[tuple[str, str], tuple[_Coder, np.ndarray]] = {}
_TABLES: dict[tuple[str, str], pa.Array] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids: a line of base64 and rank each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merges of lower rank than the token's leave of its bytes; two parts, if merges make the token."""
    parts = [bytes([b]) for b in token]
    while True:
        pairs = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs, default=(len(ranks), 0))
        if rank >= ranks[token]:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def library_form(ranks_path: str, pattern: str) -> str:
    """The tokenizers library's JSON form of a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(ranks_path), byte_characters()
    say = lambda token: "".join(table[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        parts = last_merge(token, ranks) if len(token) > 1 else ()
        if len(parts) == 2:
            merges.append((say(parts[0]), say(parts[1])))
    library = Tokenizer(models.BPE(vocab={say(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    library.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return library.to_str()


def token_bytes(library) -> pa.Array:
    """Bytes of each id, by the reversed byte table; empty where an id has no token, and one empty place at the end."""
    back = {c: b for b, c in enumerate(byte_characters())}
    known = library.get_vocab()
    out = [b""] * (max(known.values(), default=-1) + 2)
    for token, i in known.items():
        out[i] = bytes(back[c] for c in token)
    return pa.array(out, pa.binary())


class Model:
    """A rank file, its pattern and the library's form of both, for tasks."""

    def __init__(self, docs: DataFrame, ranks_path: str, pattern: str = USUAL_PATTERN):
        self.key = (ranks_path, pattern)
        self.form = docs.sparkSession.sparkContext.broadcast(library_form(ranks_path, pattern))

    def __getstate__(self):
        return {"key": self.key, "form": self.form}

    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.form.value)

    def coder(self) -> tuple[_Coder, np.ndarray]:
        """The worker's coder, and the number of bytes of each id."""
        if self.key not in _OPEN:
            library = self._library()
            sizes = pc.binary_length(token_bytes(library)).to_numpy()
            _OPEN[self.key] = _Coder(library, self.key[1] == USUAL_PATTERN, MEMO), sizes.astype(np.int64)
        return _OPEN[self.key]

    def table(self) -> pa.Array:
        if self.key not in _TABLES:
            _TABLES[self.key] = token_bytes(self._library())
        return _TABLES[self.key]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, ends of the texts in them) of an array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _ragged(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values cut at the ends, as lists, or as binary of their bytes."""
    offsets = np.concatenate([[0], ends])
    if pa.types.is_binary(kind):
        places = pa.py_buffer((offsets * values.itemsize).astype(np.int32).tobytes())
        return pa.Array.from_buffers(kind, len(ends), [None, places, pa.py_buffer(values.tobytes())])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32())).cast(kind)


def whole_characters(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of valid UTF-8 that are whole before each of the places."""
    lead = np.append((raw & 0xC0) != 0x80, True)
    begun = np.concatenate([[0], np.cumsum(lead)])
    return begun[at] - ~lead[at]


def _encoder(model: Model, keep: list[str], offsets: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = model.coder()
        for batch in batches:
            texts = batch[batch.schema.names.index("_text")]
            for lo, n in _runs(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                some = texts.slice(lo, n)
                ids = coder.encode(some, None)
                ends = np.cumsum([len(x) for x in ids])
                flat = np.concatenate(ids).astype("<u4")
                out = {c: batch[c].slice(lo, n) for c in keep}
                out["n_tokens"] = pa.array(np.diff(ends, prepend=0), pa.int64())
                out["ids"] = _ragged(flat, ends, pa.binary())
                if offsets:
                    raw, text_ends = _bytes_of(some)
                    base = np.repeat(np.concatenate([[0], text_ends[:-1]]), np.diff(ends, prepend=0))
                    at = np.cumsum(sizes[flat])
                    chars = whole_characters(raw, at) - whole_characters(raw, base)
                    kind = pa.list_(pa.int32())
                    out["byte_ends"], out["char_ends"] = (_ragged(x, ends, kind) for x in (at - base, chars))
                yield pa.RecordBatch.from_pydict(out)

    return encode


def encode_texts(docs: DataFrame, model: Model, *, text: str = "text", offsets: bool = False) -> DataFrame:
    """The other columns of docs, n_tokens, ids (binary: unsigned 32-bit little-endian); with offsets also byte_ends and char_ends.

    byte_ends and char_ends hold for each token the bytes and the whole characters of the text up to its end.
    """
    own = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    own += [StructField(c, ArrayType(IntegerType())) for c in ("byte_ends", "char_ends") if offsets]
    gone = {text, "_text", *(f.name for f in own)}
    keep = [f for f in docs.schema.fields if f.name not in gone]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in keep), F.make_valid_utf8(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_text"))
    return rows.mapInArrow(_encoder(model, [f.name for f in keep], offsets), StructType(keep + own))


def _decoded(ids: pa.Array, table: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, rows, bytes) of runs of rows of about DECODE_TOGETHER ids."""
    counts = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False) // 4
    run = np.cumsum(counts) // DECODE_TOGETHER
    starts = np.flatnonzero(np.r_[True, np.diff(run) > 0]) if len(run) else np.zeros(0, int)
    for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(run)].astype(int).tolist()):
        some = ids.slice(lo, hi - lo)
        flat = np.frombuffer(b"".join(x[: len(x) // 4 * 4] for x in some.drop_null().to_pylist()), "<u4")
        tokens = table.take(pa.array(np.minimum(flat, len(table) - 1).astype(np.int64)))
        raw, ends = _bytes_of(tokens)
        cuts = np.concatenate([[0], ends])[np.cumsum(counts[lo:hi])]
        whole = _ragged(raw, cuts, pa.binary())
        null = pc.is_null(some)
        yield lo, hi - lo, pc.if_else(null, pa.scalar(None, pa.binary()), whole) if pc.any(null).as_py() else whole


def _decoder(model: Model, keep: list[str], ids: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for lo, n, whole in _decoded(batch[ids], table):
                yield pa.RecordBatch.from_pydict({**{c: batch[c].slice(lo, n) for c in keep}, "decoded": whole})

    return decode


def decode_ids(rows: DataFrame, model: Model, *, ids: str = "ids") -> DataFrame:
    """The columns of rows and decoded (binary): the bytes of the tokens of ids (binary, as encode_texts() has them)."""
    keep = [f for f in rows.schema.fields if f.name != "decoded"]
    names = [f.name for f in keep]
    return rows.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(_decoder(model, names, ids), StructType([*keep, StructField("decoded", BinaryType())]))


def decoded_text(decoded: Column) -> Column:
    """Text of decoded bytes; parts of characters, at the ends of a run of ids or anywhere else, become U+FFFD."""
    return F.make_valid_utf8(decoded.cast("string"))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decode_ids()."""
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
