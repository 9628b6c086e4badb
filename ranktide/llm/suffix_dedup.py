"""Removing repeated byte strings by suffix arrays, exactly and over the whole corpus.

A byte goes if some ``window`` bytes that cover it also start anywhere else, in
the same text or another. How the repeats are found:

1. Every start of a window is owned by an anchor: the window's least hash of
   ``gram`` bytes. Equal windows have equal anchors, so only anchors met more
   than once matter; one is met about every (window - gram) / 2 bytes. The
   starts that share an anchor in a row are a block: its bytes and the
   window - 1 after it. Blocks that are equal are counted, not sorted: all
   their starts are repeats.
2. Different blocks of one anchor meet in a shard. A shard joins its blocks and
   builds their suffix array by Larsson and Sadakane's refinement (groups of
   suffixes not yet told apart are sorted by the ranks of their tails, at
   doubling distance) and the common prefixes of neighbours by Kasai's scan,
   run over all blocks in step. Starts whose common prefix is a window are
   repeats.
3. An anchor with more than ``ANCHOR_BYTES`` of different blocks is spread over
   several shards. Each hands on its distinct windows of that anchor as sorted runs;
   runs are cut by ranges, and within a range a binary search of each run in
   the union finds the windows that other shards have too.
4. The repeated starts go back to every text that holds the block.

What moves are the anchors' hashes once, the blocks of repeated anchors, and the
texts twice. Anchors lie packed, a row for some 8 MB of texts; their hashes go to buckets
by range and flags come back, so only anchors met more than once become rows. No
group holds more than ``ANCHOR_BYTES`` of an anchor's blocks beside a shard's bytes.

With ``keep_first``, only what has an earlier copy goes: the bytes of windows that also
start in an earlier text, or earlier in the same one. A class of equal windows then
keeps the one in the least text: of a block's occurrences the first, of blocks that
share the window the one whose first occurrence comes first.

Besides, blocks of a shorter window can be counted in the same run: bytes are told
that lie in a block which stands elsewhere, too. Nothing is sorted for that, so a
repeated string shows if it holds a whole block, as any of 3 window - 2 gram bytes
does (322 for a window of 150). They are named by their content alone.

Defined results: a null text is empty; a text shorter than the window keeps all;
copies of a text longer than the window lose everything, each of them; overlaps
within a text count; strings are judged on the input. Very long texts are worked
on in slices that overlap by a window. Empty tables give no rows. Columns kept go
by any name: those of the result come after them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, let_go, partitions, schema_of, small_batches, staged, text_keys

WINDOW = 400
SHORT = 180  # bytes
SLICE = 512 << 10  # bytes of text whose anchors are found together
PACK = 8 << 20  # bytes of text whose blocks are one row
SHARD_BYTES = 1 << 20
ANCHOR_BYTES = 2 << 20  # of an anchor's different blocks in one shard
RUN = 1024  # starts of one block at most


def gram_of(window: int) -> int:
    """Bytes of an anchor's hash: a power of two, up to half of the window."""
    return 1 << max(0, (window // 2).bit_length() - 1)


def _hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place, by doubling."""
    h = buf.astype(np.uint64) + np.uint64(1)
    base, m = 0x9E3779B97F4A7C15, 1
    while m < gram:
        h = h[:-m] * np.uint64(pow(base, m, 1 << 64)) + h[m:]
        m *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of each ``width`` values in a row, by doubling."""
    out, s = values, 1
    while 2 * s <= width:
        out = pick(out[:-s], out[s:])
        s *= 2
    if s < width:
        out = pick(out[: len(values) - width + 1], out[width - s : width - s + len(values) - width + 1])
    return out


def blocks(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """The blocks of all texts: text's number, first start, end of starts, anchor, and whether the anchor's gram
    occurs twice in the block."""
    gram = gram_of(window)
    width = window - gram + 1
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if len(buf) < window:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    grams = _hashes(buf, gram)
    least = _sliding(grams, width, np.minimum)
    valid = np.zeros(len(least), bool)
    for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
        if n >= window:
            valid[b : b + n - window + 1] = True
    before = np.concatenate([[False], valid[:-1]])
    first = np.flatnonzero(valid & (~before | (least != np.roll(least, 1))))
    last = np.flatnonzero(valid & (~np.append(valid[1:], False) | (least != np.roll(least, -1)))) + 1
    if not len(first):
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    times = -(-(last - first) // RUN)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    first, last = np.repeat(first, times) + nth * RUN, np.repeat(last, times)
    last = np.minimum(last, first + RUN)
    anchor = least[first]
    # Places whose gram is some window's least; a block with two of one value may repeat itself.
    owned = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, 0), np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(owned, width, np.maximum) == grams)
    names, which = np.unique(grams[chosen], return_inverse=True)
    n = len(buf) + 1
    key = np.sort(which * n + chosen)
    name = np.searchsorted(names, anchor)
    twice = np.searchsorted(key, name * n + last + width - 1) - np.searchsorted(key, name * n + first) > 1
    owner = np.searchsorted(begin, first, side="right") - 1
    return owner, first - begin[owner], last - begin[owner], anchor, twice


#: A slice's blocks by anchor: the text's number in the slice (``keys`` has k1 and k2 of each), first start, starts.
_FIELDS = {"a": np.int64, "c": np.int64, "owner": np.int32, "s": np.int32, "starts": np.uint16, "twice": np.bool_}
_PACKED = "slice long, w int, keys binary, " + ", ".join(f"{k} binary" for k in _FIELDS)
_BLOCKS = "w int, a long, c long, k1 long, k2 long, s int, e int, twice boolean"


def _find_blocks(windows: tuple[int, ...], counted: tuple[int, ...]):
    """Texts -> the blocks of each window length, packed: a row for ``PACK`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        number = TaskContext.get().partitionId() << 32  # no two slices of a job have the same

        def found(window: int, first: int, places: list[int], texts: list[bytes]) -> dict[str, np.ndarray]:
            """The blocks of a slice; texts are numbered from ``first`` on."""
            owner, s, e, anchor, twice = blocks(texts, window)
            content = np.frombuffer(b"".join(
                hashlib.blake2b(texts[o][a : b + window - 1], digest_size=8).digest()
                for o, a, b in zip(owner.tolist(), s.tolist(), e.tolist(), strict=True)
            ), np.int64)
            if window in counted:  # its content is a block's only name
                anchor, content, twice = content, content[:0], np.zeros(len(s), bool)
            return {
                "a": anchor.view(np.int64), "c": content, "owner": first + owner, "s": np.array(places, np.int64)[owner] + s,
                "starts": e - s, "twice": twice,
            }

        def row(window: int, keys: list, slices: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            nonlocal number
            made = {f: np.concatenate([x[f] for x in slices]) for f in _FIELDS}
            order = np.argsort(made["a"].view(np.uint64), kind="stable")
            made |= {f: v[order] for f, v in made.items() if len(v)}
            number += 1
            return pa.RecordBatch.from_pydict({
                "slice": pa.array([number]), "w": pa.array([window], pa.int32()),
                "keys": pa.array([np.array(keys, np.int64).tobytes()], pa.binary()),
                **{f: pa.array([made[f].astype(t).tobytes()], pa.binary()) for f, t in _FIELDS.items()},
            })

        class Held:
            """What a window length has waiting: texts of a slice, blocks and keys of a row."""

            def __init__(self) -> None:
                self.places, self.texts, self.size = [], [], 0
                self.keys, self.slices, self.packed = [], [], 0

        held = {w: Held() for w in (*windows, *counted)}

        def end_slice(w: int, h: Held) -> None:
            if h.texts:
                h.slices.append(found(w, len(h.keys) - len(h.texts), h.places, h.texts))
                h.packed += h.size
                h.places, h.texts, h.size = [], [], 0

        for b in small_batches(batches):
            for k1, k2, t in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
                raw = (t or "").encode()
                for w, h in held.items():
                    for at in range(0, len(raw) - w + 1, SLICE):
                        part = raw[at : at + SLICE + w - 1] if len(raw) > SLICE else raw
                        h.keys.append((k1, k2))
                        h.places.append(at)
                        h.texts.append(part)
                        h.size += len(part)
                        if h.size >= SLICE:
                            end_slice(w, h)
                        if h.packed >= PACK:
                            yield row(w, h.keys, h.slices)
                            held[w] = h = Held()
        for w, h in held.items():
            end_slice(w, h)
            if h.slices:
                yield row(w, h.keys, h.slices)

    return run


def _send_anchors(buckets: int):
    """A slice's anchors -> its distinct ones by bucket, and whether they are met in it more than once."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, w, blob, twice in zip(*(b.column(c).to_pylist() for c in ("slice", "w", "a", "twice")), strict=True):
                names, first, n = np.unique(np.frombuffer(blob, np.uint64), return_index=True, return_counts=True)
                if not len(names):
                    continue
                again = np.maximum.reduceat(np.frombuffer(twice, np.uint8), first) | (n > 1)
                cut = [0, *np.searchsorted(names, edges).tolist(), len(names)]
                some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([number] * len(some), pa.int64()), "w": pa.array([w] * len(some), pa.int32()),
                    "bucket": pa.array(some, pa.int32()),
                    "names": pa.array([names[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                    "again": pa.array([again[cut[i] : cut[i + 1]].astype(np.uint8).tobytes() for i in some], pa.binary()),
                })

    return run


def _flag_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of the anchors sent by each slice are met more than once."""
    names = np.concatenate([np.frombuffer(n, np.uint64) for n in pdf["names"]])
    again = np.frombuffer(b"".join(pdf["again"]), np.uint8)
    _, which = np.unique(names, return_inverse=True)
    times = np.bincount(which) + np.bincount(which, weights=again)
    met = times[which] > 1
    cut = np.cumsum([0, *(len(n) // 8 for n in pdf["names"])])
    flags = [met[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame({"slice": pdf["slice"], "bucket": pdf["bucket"], "met": flags})


def _unpack_met(packed: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
    """A slice's blocks whose anchors are met more than once, as rows."""
    columns = [f.split()[0] for f in _BLOCKS.split(", ")]
    if not len(packed) or not len(flags):
        return pd.DataFrame(columns=columns)
    row = packed.iloc[0]
    made = {f: np.frombuffer(row[f] or row["a"], t) for f, t in _FIELDS.items()}  # counted blocks have one name
    anchor = made["a"].view(np.uint64)
    names = np.unique(anchor)
    met = np.frombuffer(b"".join(flags.sort_values("bucket")["met"]), np.bool_)
    if len(met) != len(names):
        raise RuntimeError("a slice's anchors changed between two reads")
    some = np.flatnonzero(met[np.searchsorted(names, anchor)])
    made = {f: v[some] for f, v in made.items()}
    key = np.frombuffer(row["keys"], np.int64).reshape(-1, 2)[made["owner"]]
    return pd.DataFrame(made | {"w": row["w"], "k1": key[:, 0], "k2": key[:, 1], "e": made["s"] + made["starts"]})[columns]


def find_blocks(rows: DataFrame, windows: tuple[int, ...], counted: tuple[int, ...]) -> DataFrame:
    """The blocks of all texts whose anchors (of ``counted`` windows: contents) are met more than once. ``rows``: k1, k2, text."""
    packed = staged(rows.select("k1", "k2", "text").mapInArrow(_find_blocks(windows, counted), _PACKED), "repeat-anchors", codec="snappy")
    buckets = partitions(rows)
    sent = packed.select("slice", "w", "a", "twice").mapInArrow(
        _send_anchors(buckets), "slice long, w int, bucket int, names binary, again binary"
    )
    flags = sent.groupBy("w", "bucket").applyInPandas(_flag_anchors, "slice long, bucket int, met binary")
    return staged(packed.groupBy("slice").cogroup(flags.groupBy("slice")).applyInPandas(_unpack_met, _BLOCKS), "repeat-blocks")


def _in_order(key: np.ndarray, at: np.ndarray, bits: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in order, and their places; both are sorted as one number where they fit."""
    if bits + places <= 63:
        both = np.sort(key << places | at)
        return both >> places, (both & ((1 << places) - 1)).astype(np.int32)
    again = np.argsort(key, kind="stable")
    return key[again], at[again]


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' places in order, and each place's rank. The end is below every byte."""
    n = len(text)
    buf = np.frombuffer(text, np.uint8)
    seen = np.flatnonzero(np.bincount(buf, minlength=256))
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, len(seen) + 1)
    places, bits = n.bit_length(), len(seen).bit_length()
    h = max(1, (63 - min(places, 21)) // bits)  # symbols sorted by at first
    symbols = np.concatenate([code[buf], np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << bits | symbols[j : j + n]
    key, order = _in_order(key, np.arange(n, dtype=np.int32), h * bits, places)
    del symbols
    slots = np.arange(n, dtype=np.int32)
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    while True:
        alone = head & np.append(head[1:], True)
        slots = slots[~alone[slots]]
        if not len(slots):
            return order, rank
        at = order[slots]
        after = at + np.int32(h)
        key = rank[at].astype(np.int64) << places
        inside = after < n
        key[inside] |= rank[after[inside]] + 1
        key, at = _in_order(key, at, 2 * places, places)
        order[slots] = at
        head[slots] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(head[slots], slots, 0))
        h *= 2


def common_prefixes(text: bytes, order: np.ndarray, rank: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """For each slot of the order the common prefix with the slot before it, up to ``most``.

    Kasai's scan: going one place on loses at most one byte. The ``size`` places
    ``begin``, ``begin + 1``, ... of each block are scanned in step. ``order`` (and each
    place's ``rank`` in it) may leave out places between blocks: behind the last
    place of a block nothing is known of the next one's neighbour, so it begins anew.
    """
    n = len(text)
    out = np.zeros(len(order), np.int32)
    last = np.zeros(n + 1, bool)
    last[begin + size - 1] = True
    eights = np.ndarray((n + 64,), "<u8", text + b"\0" * 72, strides=(1,)).copy()
    words = np.arange(0, 64, 8)
    lanes = np.argsort(-size, kind="stable")
    begin, size = begin[lanes], size[lanes]
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
    have = np.zeros(len(begin), np.int64)

    def equal_bytes(differ: np.ndarray) -> np.ndarray:
        return np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3  # zero bits below the lowest one set

    def room(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return n - np.maximum(a, b)  # what lies behind the end is no match

    for step, k in enumerate(active.tolist()):
        i = begin[:k] + step
        slot = rank[i]
        l = np.maximum(have[:k] - 1, 0)  # noqa: E741
        first = np.flatnonzero(slot == 0)  # nothing before it
        j = order[slot - 1].astype(np.int64)
        j[first], l[first] = n, 0
        a, b = i + l, j + l
        more = np.minimum(equal_bytes(eights[a] ^ eights[b]), room(a, b))
        l += more
        going = np.flatnonzero((more == 8) & (l < most))
        while len(going):
            a, b = i[going] + l[going], j[going] + l[going]
            differ = eights[a[:, None] + words] ^ eights[b[:, None] + words]
            word = (differ != 0).argmax(1)
            differ = differ[np.arange(len(word)), word]
            more = np.minimum(np.where(differ == 0, 64, 8 * word + equal_bytes(differ)), room(a, b))
            l[going] += more
            going = going[(more == 64) & (l[going] < most)]
        np.minimum(l, most, out=l)
        out[slot] = l
        l[last[j]] = 0
        have[:k] = l
    return out


def _starts_to_ranges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(at):
        return at, at
    first = np.concatenate([[True], at[1:] != at[:-1] + 1])
    last = np.concatenate([at[1:] != at[:-1] + 1, [True]])
    return at[first], at[last] + 1


#: Ranges of a block's starts; the first place of the block (k1, k2, s); a window asked of other shards (d1, d2, shard).
_FOUND = "w int, a long, c long, k1 long, k2 long, s int, lo int, hi int, d1 long, d2 long, sure boolean, shard int"
_RANGE = ["w", "a", "c", "k1", "k2", "s", "lo", "hi"]


def _search_shard(keep_first: bool):
    """A shard's blocks -> ranges of repeated starts, and the distinct windows of anchors that other shards share."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        window = int(pdf["w"].iloc[0])
        pdf = pdf.drop_duplicates(["a", "c"]).sort_values(["k1", "k2", "s"])  # equal windows: the first block's goes first
        size = np.fromiter(map(len, pdf["block"]), np.int64, len(pdf))
        text = b"".join(pdf.pop("block"))
        begin = np.cumsum(size) - size
        starts = size - (window - 1)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), starts)
        place = np.arange(len(owner), dtype=np.int32) + np.repeat((begin - (np.cumsum(starts) - starts)).astype(np.int32), starts)
        order, rank = suffix_array(text)
        begins = np.zeros(len(text), bool)  # only places that begin a window are compared with each other
        begins[place] = True
        order = order[begins[order]]
        rank[order] = np.arange(len(order), dtype=np.int32)
        prefix = common_prefixes(text, order, rank, begin, starts, window)
        del order, begins
        cls = np.cumsum(prefix < window, dtype=np.int32)[rank[place]]  # equal windows are neighbours
        del rank, prefix
        n, shared = pdf["n"].to_numpy(), pdf["shared"].to_numpy()
        earliest = _earliest(cls, owner, place - begin[owner], pdf) if keep_first or shared.any() else None
        if keep_first:
            sure = np.ones(len(cls), bool)
            sure[earliest] = False
            gone = sure
        else:
            sure = (np.bincount(cls, weights=n[owner]) > 1)[cls]
            gone = sure & (n == 1)[owner]  # blocks met more than once are repeats as a whole
        # Starts of different blocks never touch: a gap of a window's length lies between them.
        lo, hi = _starts_to_ranges(place[np.flatnonzero(gone)])
        own = np.searchsorted(begin, lo, side="right") - 1
        named = pdf[["w", "a", "c", "k1", "k2", "s"]]
        rows = [named.iloc[own].assign(lo=lo - begin[own], hi=hi - begin[own], d1=0, d2=0, sure=True, shard=-1)]
        ask = earliest[shared[owner[earliest]]] if shared.any() else ()
        if len(ask):
            digest = np.frombuffer(b"".join(
                hashlib.blake2b(text[p : p + window], digest_size=16).digest() for p in place[ask].tolist()
            ), np.int64).reshape(-1, 2)
            own = owner[ask]
            inside = place[ask] - begin[own]
            # A block met more than once is a repeat whatever other shards hold.
            known = np.zeros(len(ask), bool) if keep_first else sure[ask] | (n[own] > 1)
            rows.append(named.iloc[own].assign(
                lo=inside, hi=inside + 1, d1=digest[:, 0], d2=digest[:, 1], sure=known, shard=pdf["shard"].to_numpy()[own]
            ))
        return pd.concat(rows)[[f.split()[0] for f in _FOUND.split(", ")]]

    return run


def _earliest(cls: np.ndarray, owner: np.ndarray, inside: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
    """Of each class of equal windows the start that comes first, by its block's first place."""
    text = np.cumsum(np.concatenate([[0], (np.diff(pdf["k1"]) != 0) | (np.diff(pdf["k2"]) != 0)]))
    key = text[owner] << 32 | (pdf["s"].to_numpy()[owner] + inside)
    order = np.lexsort((key, cls))
    return order[np.flatnonzero(np.diff(cls[order], prepend=-1))]


def _merge_runs(keep_first: bool):
    """Ranges already sure, and windows that more than one shard has: each shard's sorted run is searched in the union.
    With ``keep_first`` the one of them that comes first stays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["shard"].to_numpy() >= 0
        rows = [pdf.loc[~asked, _RANGE]]
        some = pdf[asked]
        if len(some):
            some = some.assign(at=some["s"] + some["lo"]).sort_values(["k1", "k2", "at"])
            key = np.rec.fromarrays([some["d1"].to_numpy(), some["d2"].to_numpy()], names="d1,d2")
            turn = np.argsort(key, kind="stable", order=("d1", "d2"))  # equal windows: the first goes first
            union = key[turn]
            plain = union["d1"]
            shard = some["shard"].to_numpy()
            for one in np.unique(shard):
                mine = np.flatnonzero((shard == one) & ~some["sure"].to_numpy())
                a = np.searchsorted(plain, key["d1"][mine])
                b = np.searchsorted(plain, key["d1"][mine], side="right")
                hit = []
                for i in np.flatnonzero(b - a > 1).tolist():
                    same = turn[a[i] : b[i]][union["d2"][a[i] : b[i]] == key["d2"][mine[i]]]
                    if len(same) > 1 and not (keep_first and same[0] == mine[i]):
                        hit.append(i)
                rows.append(some.iloc[mine[hit]][_RANGE])
        return pd.concat(rows)

    return run


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the blocks wanted of them -> the blocks' bytes."""
    for b in small_batches(batches):
        for k1, k2, text, want in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text", "want")), strict=True):
            raw = text.encode()
            yield pa.RecordBatch.from_pydict({
                "k1": pa.array([k1] * len(want), pa.int64()), "k2": pa.array([k2] * len(want), pa.int64()),
                **{k: pa.array([w[k] for w in want], t) for k, t in _WANTED.items()},
                "block": pa.array([raw[w["s"] : w["e"] + w["w"] - 1] for w in want], pa.binary()),
            })


_WANTED = {"shard": pa.int32(), "w": pa.int32(), "a": pa.int64(), "c": pa.int64(), "n": pa.int64(), "s": pa.int32(), "shared": pa.bool_()}


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges that touch as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _cut(raw: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _remove(keep: int, window: int, short: int | None, as_text: bool):
    """Rows with their spans -> what is left of the text."""
    spans_of = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = []
            for text, found in zip(b.column("_text").to_pylist(), b.column("_found").to_pylist(), strict=True):
                raw = (text or "").encode()
                of = {w: merged([(f["lo"], f["hi"]) for f in found or () if f["w"] == w]) for w in (window, short)}
                rest, size = _cut(raw, of[window]), [hi - lo for lo, hi in of[short]]
                rows.append((
                    len(raw), len(raw) - len(rest), len(of[window]), hashlib.sha256(rest).hexdigest(), sum(size), len(size), max(size, default=0),
                    rest.decode("utf-8", "ignore") if as_text else rest, [{"lo": lo, "hi": hi} for lo, hi in of[window]],
                ))
            out = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3 + [pa.string() if as_text else pa.binary(), spans_of]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:keep], *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=[*b.schema.names[:keep], *_RESULT]
            )

    return run


_RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_repeats", "longest_repeat", "kept", "spans"]


def repeated_ranges(
    rows: DataFrame, *windows: int, counted: tuple[int, ...] = (), keep_first: bool = False, shard_bytes: int = SHARD_BYTES, anchor_bytes: int = ANCHOR_BYTES
) -> DataFrame:
    """k1, k2 (a text's key) and ``found``: its ranges of bytes (lo, hi) that are repeats of a window's length (w).

    ``rows``: k1, k2, doc_id, text. Of ``counted`` windows, ranges are blocks that stand elsewhere. With ``keep_first`` ranges are later copies only, in the order of the keys.
    """
    some = find_blocks(rows, windows, counted)
    first = F.min(F.struct("k1", "k2", "s", "e")).alias("first")
    distinct = staged(
        some.groupBy("w", "a", "c").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), first), "repeat-distinct"
    )
    size = (F.col("first.e") - F.col("first.s") + F.col("w") - 1).cast("long")
    by_anchor = distinct.groupBy("w", "a").agg(F.count("*").alias("different"), F.max("twice").alias("any"), F.sum(size).alias("held"))
    # Sums are written before they are joined: a join of two plain tables can split the rows of a hot key.
    to_sort = distinct.join(staged(by_anchor.where("different > 1 OR any"), "repeat-counts"), ["w", "a"])
    total = to_sort.agg(F.sum(size).alias("n")).first()["n"] or 0
    shards = max(partitions(rows), -(-int(total) // shard_bytes))
    # An anchor's blocks meet in one shard, or in as many as hold ``anchor_bytes`` each.
    large = F.col("held") > anchor_bytes
    spread = F.when(large, F.pmod(F.col("c"), F.ceil(F.col("held") / anchor_bytes))).otherwise(F.lit(0))
    wanted = to_sort.select(
        F.col("first.k1"), F.col("first.k2"),
        F.struct(
            F.pmod(F.xxhash64("a", spread), F.lit(shards)).cast("int").alias("shard"), "w", "a", "c", "n",
            large.alias("shared"), F.col("first.s").alias("s"), F.col("first.e").alias("e"),
        ).alias("want"),
    ).groupBy("k1", "k2").agg(F.collect_list("want").alias("want"))
    # One row of each text will do.
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("place")
    one = rows.groupBy("k1", "k2").agg(F.min(place).alias("place"))
    texts = rows.withColumn("place", place).drop("doc_id").join(wanted.join(one, ["k1", "k2"]), ["k1", "k2", "place"])
    cut = texts.select("k1", "k2", "text", "want").mapInArrow(
        _cut_blocks, "k1 long, k2 long, shard int, w int, a long, c long, n long, s int, shared boolean, block binary"
    )
    sorted_ = cut.groupBy("w", "shard").applyInPandas(_search_shard(keep_first), _FOUND)
    ranges = partitions(rows)
    # Runs are cut by the windows' digests, as signed numbers in order; the rest just passes.
    part = F.when(F.col("shard") >= 0, F.floor(F.shiftright("d1", 32) / F.lit((1 << 32) / ranges))).otherwise(
        F.pmod(F.xxhash64("a", "c"), F.lit(ranges))
    )
    found = sorted_.groupBy(part.alias("part")).applyInPandas(
        _merge_runs(keep_first), "w int, a long, c long, k1 long, k2 long, s int, lo int, hi int"
    ).select("w", "a", "c", F.struct("k1", "k2", "s").alias("first"), "lo", "hi", F.lit(False).alias("others"))
    whole = distinct.where("n > 1").select(
        "w", "a", "c", F.struct("first.k1", "first.k2", "first.s").alias("first"), F.lit(0).alias("lo"),
        (F.col("first.e") - F.col("first.s")).alias("hi"), F.lit(True).alias("others"),
    )
    hits = some.join(whole.unionByName(found), ["w", "a", "c"])
    if keep_first:  # a block's ranges are its first occurrence's; all others go as a whole
        hits = hits.where((F.col("first") == F.struct("k1", "k2", "s")) != F.col("others"))
    hits = hits.select(
        "k1", "k2", F.struct("w", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi") + F.col("w") - 1).alias("hi")).alias("hit")
    )
    return staged(hits.groupBy("k1", "k2").agg(F.collect_set("hit").alias("found")), "repeat-ranges")


def remove_repeats(
    docs: DataFrame, *keep: str, window: int = WINDOW, short: int | None = None, as_text: bool = False, keep_first: bool = False,
    shard_bytes: int = SHARD_BYTES, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """The ``keep`` columns of every row with n_bytes, n_removed, n_spans, kept_sha256, n_repeated, n_repeats,
    longest_repeat, kept and spans.

    ``kept`` is the bytes left, or as text these without what a cut has left of a
    character. With ``short`` (another length than ``window``), n_repeated counts the
    bytes in blocks of that window which stand elsewhere, too (each at least that
    long), n_repeats the runs of such bytes and longest_repeat the longest run's;
    nothing more is removed for them. With
    ``keep_first`` the copy in the row of the least doc_id (null last) stays, and all
    figures are of later copies; rows of one doc_id and text count as one.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    k1, k2 = text_keys()
    if keep_first:
        k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)],
        F.col("doc_id").alias("_id"), F.col("text").alias("_text"), k1.alias("_k1"), k2.alias("_k2"),
    )
    keys = [F.col("_k1").alias("k1"), F.col("_k2").alias("k2")]
    found = repeated_ranges(
        rows.select(*keys, F.col("_id").alias("doc_id"), F.col("_text").alias("text")), window, counted=() if short is None else (short,),
        keep_first=keep_first, shard_bytes=shard_bytes, anchor_bytes=anchor_bytes,
    )
    by_key = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("found").alias("_found"))
    both = rows.join(by_key, ["_k1", "_k2"], "left").select(*names, "_text", "_found")
    out = both.mapInArrow(
        _remove(len(keep), window, short, as_text),
        schema_of(
            rows, names, "n_bytes long, n_removed long, n_spans long, kept_sha256 string",
            "n_repeated long, n_repeats long, longest_repeat long",
            f"kept {'string' if as_text else 'binary'}, spans array<struct<lo:int,hi:int>>",
        ),
    )
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], *_RESULT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps, and how much of it are shorter repeats, from passages of about fifty words on."""
    found = remove_repeats(documents(spark, sf_dir), "doc_id", short=SHORT)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_repeats", "longest_repeat")
