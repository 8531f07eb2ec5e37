"""Simple-8b: word-aligned coding of unsigned integers.

A 64-bit word holds a selector in its top four bits and, below it, ``COUNTS[s]``
values of ``BITS[s]`` bits each, the first value lowest. Selector 0 stands for 240
zeros. Selector 1 is the escape: its payload is an index into the block's list of
whole 64-bit values, for values that need over 60 bits; keeping them apart lets
every word be decoded without looking at its neighbours.

A stream is cut into blocks of a fixed number of values; blocks start at a word,
and the offsets of blocks in words are stored, so any block can be decoded alone.
Both directions work on many blocks at once: each step of the encoder places one
word in every block that is not full yet.
"""

from __future__ import annotations

import numpy as np

ESCAPE = 1
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
#: Values in a block, values that are coded together, and room behind a block for what its last word doesn't use.
BLOCK, TOGETHER, ROOM = 1 << 10, 1 << 18, 240

_U = np.uint64
_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits of each value; beyond 2^53 perhaps one more, which only makes the choice wider."""
    if not len(v) or int(v.max()) < 1 << 16:
        return _WIDTH[v.astype(np.int64)]
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)


def _choices(v: np.ndarray) -> np.ndarray:
    """For each place, the selector that packs most values from there on; zeros behind a block's end fit anything."""
    widest = _widths(v)
    best = np.full(len(v), 15, np.uint8)
    span = 1
    for s in [*range(14, 1, -1), 0]:
        # the widest of the next COUNTS[s] values, from that of fewer
        while span < COUNTS[s]:
            step = min(span, int(COUNTS[s]) - span)
            widest = np.maximum(widest, np.concatenate([widest[step:], np.zeros(step, np.uint8)]))
            span += step
        best[widest <= BITS[s]] = s
    best[v >> _U(60) != 0] = ESCAPE
    return best


def _encode_blocks(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words by block, escaped, escaped by block) of whole blocks, of which the last may be short."""
    n = len(values)
    blocks = -(-n // block)
    stride = block + ROOM
    wide = np.zeros((blocks, stride), _U)
    full = n // block
    wide[:full, :block] = values[: full * block].reshape(full, block)
    if full < blocks:
        wide[full, : n - full * block] = values[full * block :]
    v = wide.ravel()
    choice = _choices(v)
    step = COUNTS[choice]
    at = np.arange(blocks, dtype=np.int64) * stride
    end = at + np.minimum(block, n - np.arange(blocks, dtype=np.int64) * block)
    starts = np.zeros(len(v), bool)
    while len(at):
        starts[at] = True
        at = at + step[at]
        going = at < end
        if not going.all():
            at, end = at[going], end[going]
    first = np.flatnonzero(starts)
    picked = choice[first]
    words = picked.astype(_U) << _U(60)
    for s in range(2, 16):
        mine = np.flatnonzero(picked == s)
        if len(mine):
            place, word = first[mine], words[mine]
            for k in range(COUNTS[s]):
                word |= v[place + k] << _U(BITS[s] * k)
            words[mine] = word
    owner = first // stride
    gone = np.flatnonzero(picked == ESCAPE)
    escapes = np.bincount(owner[gone], minlength=blocks)
    before = np.cumsum(escapes) - escapes
    words[gone] |= (np.arange(len(gone)) - before[owner[gone]]).astype(_U)
    return words, np.bincount(owner, minlength=blocks), v[first[gone]], escapes


def _decode_blocks(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, escape_offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """The n values of whole blocks; offsets are those of the blocks and the end."""
    picked = (words >> _U(60)).astype(np.int64)
    count = COUNTS[picked]
    blocks, stride = len(offsets) - 1, block + ROOM
    owner = np.repeat(np.arange(blocks), np.diff(offsets))
    start = np.cumsum(count) - count
    place = start - start[offsets[:-1]][owner] + owner * stride
    out = np.zeros(blocks * stride, _U)
    for s in range(2, 16):
        mine = np.flatnonzero(picked == s)
        if len(mine):
            w, at, mask = words[mine], place[mine], _U((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                out[at + k] = (w >> _U(BITS[s] * k)) & mask
    gone = np.flatnonzero(picked == ESCAPE)
    if len(gone):
        rank = (words[gone] & _U((1 << 60) - 1)).astype(np.int64)
        out[place[gone]] = escaped[rank + escape_offsets[:-1][owner[gone]]]
    return out.reshape(blocks, stride)[:, :block].ravel()[:n]


def encode(values: np.ndarray, block: int = BLOCK) -> dict[str, np.ndarray]:
    """words, offsets (of each block's words, and the end), escaped, escape_offsets of a whole stream."""
    v = np.ascontiguousarray(values, _U)
    step = max(1, TOGETHER // block) * block
    parts = [_encode_blocks(v[k : k + step], block) for k in range(0, len(v), step)]
    join = lambda i, kind: np.concatenate([np.zeros(0, kind), *[p[i] for p in parts]]).astype(kind)
    ends = lambda i: np.concatenate([np.zeros(1, _U), np.cumsum(join(i, np.int64)).astype(_U)])
    return {"words": join(0, _U), "offsets": ends(1), "escaped": join(2, _U), "escape_offsets": ends(3)}


def decode(stream: dict[str, np.ndarray], n: int, first: int = 0, last: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Values first to last (exclusive) of a stream of n, decoding only the blocks that hold them."""
    last = n if last is None else last
    if first >= last:
        return np.zeros(0, _U)
    out, step = [], max(1, TOGETHER // block)
    ends, escape_ends = stream["offsets"].astype(np.int64), stream["escape_offsets"].astype(np.int64)
    stop = -(-last // block)
    for b in range(first // block, stop, step):
        c = min(b + step, stop)
        o, e = ends[b : c + 1], escape_ends[b : c + 1]
        part = _decode_blocks(stream["words"][o[0] : o[-1]], o - o[0], stream["escaped"][e[0] : e[-1]], e - e[0], min(c * block, n) - b * block, block)
        out.append(part)
    base = first // block * block
    return np.concatenate(out)[first - base : last - base]
