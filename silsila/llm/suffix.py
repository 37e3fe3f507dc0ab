"""Removal of repeated byte strings: suffix order, Burrows-Wheeler transform, threshold-bounded interval expansion.

Every string of MIN bytes (a window) is assigned to its anchor: the GRAM-byte gram inside it with the least hash,
leftmost on ties. Equal windows have equal anchors, so windows can be compared anchor by anchor. Neighbouring windows
with the same anchor make one unit: a stretch of at most 2 * MIN bytes. Units whose anchor occurs once in the corpus
hold nothing repeated; equal units are settled by counting them; what is left, different units with a common anchor,
is compared by content.

There the units of many anchors make a block of bounded size. Its suffixes are sorted to more than MIN symbols, and
the Burrows-Wheeler transform is searched breadth first: the interval of a string is extended backward by each
preceding symbol, which finds the borders between suffixes by increasing length of their common prefix. The search
stops at MIN; borders that it has not reached by then are those between suffixes with MIN or more symbols in common.
Intervals are extended run by run of the transform, so wide intervals of repetitive text cost little.

An anchor with more units than a block holds is split: windows in steps of their distance from the anchor share a
core, whose hash is a finer anchor. Steps shrink to single windows, which are settled by counting alone.

Passages of a number of words can be removed or reported too, whatever their bytes: windows of so many words meet by
their least gram of WORD_GRAM words and make units in the same way; windows of different units are hashed and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, bucket_count, chunks, flat, map_arrow, materialise, mix64, span_hashes, stored_table, utf8, word_spans

MIN, GRAM = 400, 32
GRAMS = MIN - GRAM + 1
#: Bytes of unit contents in a block, and beyond which one anchor's units are split.
BLOCK = 1 << 18
#: Windows in a part of a unit when an anchor is split, and split again.
STEPS = (47, 6, 1)
#: A longer text is searched for units in overlapping segments of this size.
SEGMENT = 1 << 20
#: Words of a passage that pipelines remove, and op2 reports, wherever it repeats, and of the grams that windows of words meet by.
PASSAGE, WORD_GRAM = 51, 8
_BYTE = mix64(np.arange(1, 257).astype(np.uint64))

UNITS = "rid long, start long, windows int, unit int, anchor long, hash long, occ int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte grams, by doubling."""
    h, size = _BYTE[data], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0xD1342543DE82EF95 + 2 * size) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return mix64(h)


def anchors(grams: np.ndarray, width: int = GRAMS) -> np.ndarray:
    """For each window of `width` grams the place of the least (40 bits of it, then the leftmost): block-wise running minima."""
    n, w = len(grams), width
    low = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n).astype(np.uint64)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = low
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def find_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, unit, anchor, hash, occ) of all units in a flat batch of less than 2**24 bytes.

    Equal units that follow one another directly (periodic text) are one row with occ of them.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < MIN:
        return empty
    valid = np.zeros(len(data) + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= MIN)
    if not len(long):
        return empty
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long + 1] - MIN + 1, -1)
    valid = (np.cumsum(valid) > 0)[: len(data) - MIN + 1]
    grams = gram_hashes(data)
    at = anchors(grams)
    head = valid.copy()
    head[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    start = np.flatnonzero(head)
    tail = valid.copy()
    tail[:-1] &= head[1:] | ~valid[1:]
    windows = np.flatnonzero(tail) - start + 1
    anchor = grams[at[start]].view(np.int64)
    hashes = span_hashes(data, start, start + windows + MIN - 1).view(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (hashes[1:] != hashes[:-1]) | (start[1:] != start[:-1] + windows[:-1])
    first = np.flatnonzero(new)
    occ = np.diff(np.append(first, len(start)))
    return start[first], np.add.reduceat(windows, first), windows[first], anchor[first], hashes[first], occ


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in UNITS.split(", ")]

    def out(rid, found, shift=0):
        start, windows, unit, anchor, hashes, occ = found
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start + shift), *(pa.array(x.astype(np.int32)) for x in (windows, unit)), pa.array(anchor), pa.array(hashes), pa.array(occ.astype(np.int32))], names)

    for whole in batches:
        for batch in chunks(whole, "raw"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat(batch, "raw")
            if batch.num_rows > 1 or len(data) <= SEGMENT + MIN:
                found = find_units(data, offsets)
                row = np.searchsorted(offsets, found[0], "right") - 1
                yield out(ids[row], (found[0] - offsets[row], *found[1:]))
            else:  # one long text
                for a in range(0, len(data) - MIN + 1, SEGMENT):
                    part = data[a : a + SEGMENT + MIN - 1]
                    found = find_units(part, np.array([0, len(part)]))
                    yield out(np.full(len(found[0]), ids[0]), found, a)


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffixes of text (symbols below 512, the last one unique and least) in order of their first 448 symbols."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(9)
        key[: n - k] |= text[k:].astype(np.uint64)
    h = 7
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if h >= MIN or new.all():
            return order
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: n - h] |= rank[h:].astype(np.uint64)
        h *= 2


def long_borders(text: np.ndarray, order: np.ndarray, least: int = MIN) -> np.ndarray:
    """n+1 booleans: whether the suffixes at places i-1 and i of the order have `least` or more symbols in common."""
    n = len(text)
    last = text[order - 1]  # the transform; the symbol before the first one is the last, which is unique
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int32)
    step[by_symbol] = np.arange(n, dtype=np.int32)
    del by_symbol
    change = np.ones(n, bool)
    change[1:] = last[1:] != last[:-1]
    run_from = np.flatnonzero(change)
    run_to = np.append(run_from[1:], n)
    run_of = np.cumsum(change) - 1
    symbol = last[run_from].astype(np.int64)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(least):
        if not len(lo):
            break
        first = run_of[lo]
        count = run_of[hi - 1] - first + 1
        owner = np.repeat(np.arange(len(lo)), count)
        runs = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        a, b = np.maximum(run_from[runs], lo[owner]), np.minimum(run_to[runs], hi[owner]) - 1
        key = owner * 512 + symbol[runs]
        if len(key) > len(lo):
            at = np.argsort(key, kind="stable")
            key, a, b = key[at], a[at], b[at]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        ends = np.append(np.flatnonzero(head)[1:], len(key)) - 1
        lo, hi = step[a[head]], step[b[ends]] + 1
        fresh = unset[hi]
        unset[hi] = False
        lo, hi = lo[fresh], hi[fresh]
    return unset


def repeated_windows(contents: list[bytes]) -> list[np.ndarray]:
    """For each content, whether the MIN-byte string at each of its len-MIN+1 starts occurs elsewhere in them all."""
    sizes = np.array([len(c) for c in contents])
    text = np.full(int(sizes.sum()) + len(contents) + 1, 1, np.uint16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\0".join(contents), np.uint8).astype(np.uint16) + 2
    text[: len(joined)] = joined
    text[starts[1:] - 1] = 1
    text[-2:] = (1, 0)
    order = sort_suffixes(text)
    border = long_borders(text, order)
    twice = np.zeros(len(text), bool)
    twice[order] = border[:-1] | border[1:]
    return [twice[s : s + size - MIN + 1] for s, size in zip(starts, sizes, strict=True)]


def true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


SPANS = "rid long, start long, windows int"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, rid, start, content) sorted by key: the repeated windows of contents that occur once."""

    def settle(rows):
        spans = []
        for (_, n, rid, start, _), flags in zip(rows, repeated_windows([r[4] for r in rows]), strict=True):
            if n == 1:
                spans += [(rid, start + a, c) for a, c in zip(*(x.tolist() for x in true_runs(flags)), strict=True)]
        cols = list(zip(*spans, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["rid", "start", "windows"])

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held >= BLOCK and row[0] != rows[-1][0]:
                yield settle(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
    if rows:
        yield settle(rows)


def expand(units: DataFrame) -> DataFrame:
    """Compare different units (key, n, rid, start, content) with the same key; each key's contents fit in a block."""
    return units.select("key", "n", "rid", "start", "content").repartition("key").sortWithinPartitions("key").transform(map_arrow, _expand, SPANS)


def _parts(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for n, rid, start, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(content, np.uint8)
                grams = gram_hashes(data)
                place = int(anchors(grams)[0])
                gram = int(grams[place].view(np.int64))
                windows = len(data) - MIN + 1
                # Windows at the same distance from the anchor, divided by step, share the core that all of them contain.
                group = (place - np.arange(windows)) // step
                heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), windows], strict=True):
                    g = int(group[a])
                    first, last = place - (g * step + step - 1), place - g * step
                    core = content[max(last, 0) : first + MIN]
                    key = hashlib.blake2b(core, digest_size=8, salt=g.to_bytes(8, "little", signed=True), key=gram.to_bytes(8, "little", signed=True)).digest()
                    part = content[a : b - 1 + MIN]
                    for col, x in zip(cols, (int.from_bytes(key, "little", signed=True), int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True), n, rid, start + a, b - a, part), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "hash", "n", "rid", "start", "windows", "content"])

    return run


def split(units: DataFrame, step: int) -> DataFrame:
    """Units cut to parts of at most `step` windows, keyed by the core of their windows: key, hash, n, rid, start, windows, content."""
    spread = units.select("n", "rid", "start", "content").repartition("rid", "start")
    return spread.transform(map_arrow, _parts(step), "key long, hash long, n long, rid long, start long, windows int, content binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "hash", "n", "rid", "start", "hot", "content"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for rid, raw, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for u in units:
                for col, x in zip(cols, (u["anchor"], u["hash"], u["n"], rid, u["start"], u["hot"], raw[u["start"] : u["start"] + u["unit"] + MIN - 1]), strict=True):
                    col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans (from, to) that meet or overlap as one, in order."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _digest(least: int, with_text: bool, reported: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            n_bytes, removed, n_spans, digests, texts, n_passages, passage_bytes = [], [], [], [], [], [], []
            for raw, spans in zip(rows["raw"], rows["spans"], strict=True):
                raw = raw or b""
                merged = _merged([(s["start"], s["start"] + s["windows"] - 1 + least) for s in spans or () if not (reported and s["passage"])])
                if reported:
                    passages = _merged([(s["start"], s["start"] + s["windows"] - 1 + least) for s in spans or () if s["passage"]])
                    n_passages.append(len(passages))
                    passage_bytes.append(sum(b - a for a, b in passages))
                n_bytes.append(len(raw))
                removed.append(sum(b - a for a, b in merged))
                n_spans.append(len(merged))
                digests.append(hashlib.sha256(_without(raw, merged)).hexdigest())
                if with_text:
                    texts.append(_without(raw, [x for x in (_whole(raw, a, b) for a, b in merged) if x[0] < x[1]]).decode("utf-8", "replace"))
            cols = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if reported:
                cols, names = [*cols, pa.array(n_passages, pa.int64()), pa.array(passage_bytes, pa.int64())], [*names, "n_passages", "passage_bytes"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())] if with_text else cols, [*names, "kept_text"] if with_text else names)

    return run


def _without(raw: bytes, spans: list) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of a span that holds whole characters."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _bucketed(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """rid, raw, row: numbered rows, stored once in buckets by rid so that later joins leave the texts where they are."""
    n = bucket_count(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    own = [] if "text" in carry else [utf8("text").alias("raw")]  # a carried text is not stored twice
    stored = stored_table(docs.select(F.monotonically_increasing_id().alias("rid"), row, *own).repartition(n, "rid"), "rid", n)
    return stored.select("rid", F.col("raw") if own else F.col("row.text").cast("binary").alias("raw"), "row")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """rid, start, windows from rid, raw: stretches of starts whose MIN-byte strings also start elsewhere in the corpus."""
    units = materialise(texts.select("rid", "raw").transform(map_arrow, _units, UNITS), "repeat-units")
    # Tables of their own, here and below: Spark can then split the hot keys of the joins with them.
    common = materialise(units.groupBy("anchor").agg(F.sum("occ").alias("total")).filter("total > 1").select("anchor"), "repeat-common")
    shared = materialise(units.join(common, "anchor", "left_semi"), "repeat-shared")
    counted = materialise(shared.groupBy("anchor", "hash").agg(F.sum("occ").alias("n"), F.min(F.struct("rid", "start", "unit")).alias("rep")), "repeat-counted")
    settled = [shared.join(counted.filter("n > 1").select("anchor", "hash"), ["anchor", "hash"], "left_semi").select("rid", "start", "windows")]
    several = counted.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.col("rep.unit") + MIN).alias("size")).filter("k > 1").select("anchor", (F.col("size") > BLOCK).alias("hot"))
    several = materialise(several, "repeat-several")
    wanted = counted.join(several, "anchor").select(F.col("rep.rid").alias("rid"), F.struct("anchor", "hash", "n", F.col("rep.start").alias("start"), F.col("rep.unit").alias("unit"), "hot").alias("u"))
    by_text = wanted.groupBy("rid").agg(F.collect_list("u").alias("units"))
    kinds = "key long, hash long, n long, rid long, start long, hot boolean, content binary"
    contents = materialise(texts.select("rid", "raw").join(by_text, "rid").select("rid", "raw", "units").transform(map_arrow, _cut, kinds), "repeat-contents")
    settled.append(expand(contents.filter("not hot")))
    rest = contents.filter("hot")
    for step in STEPS:
        if rest.isEmpty():
            break
        parts = materialise(split(rest, step), "repeat-parts")
        counts = materialise(parts.groupBy("key", "hash").agg(F.sum("n").alias("total"), F.min(F.struct("rid", "start")).alias("rep")), "repeat-counted")
        settled.append(parts.filter("n = 1").join(counts.filter("total > 1").select("key", "hash"), ["key", "hash"], "left_semi").select("rid", "start", "windows"))
        several = counts.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key", (F.col("k") * (MIN + step) > BLOCK).alias("hot"))
        several = materialise(several, "repeat-several")
        left = counts.join(several, "key").select("key", "hash", "total", "hot", F.col("rep.rid").alias("rid"), F.col("rep.start").alias("start"))
        compared = materialise(parts.drop("n").join(left, ["key", "hash", "rid", "start"]).select("key", "hash", F.col("total").alias("n"), "rid", "start", "hot", "content"), "repeat-contents")
        settled.append(expand(compared.filter("not hot")))
        rest = compared.filter("hot")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` hashes."""
    up, down = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix64((total[size:] - total[:-size]) * down[: len(hashes) - size + 1])


def word_windows(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(start, end, row, place, anchor, hash) of all windows of `words` words, by their words whatever is between them."""
    starts, ends, first = word_spans(data, offsets)
    n, width = len(starts) - words + 1, words - WORD_GRAM + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes, row = span_hashes(data, starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[words - 1 :])
    grams = _rolled(hashes, WORD_GRAM)
    place = np.concatenate([anchors(grams[a : a + SEGMENT + width - 1], width) + a for a in range(0, n, SEGMENT)])[at]
    return starts[at], ends[at + words - 1], row[at], place, grams[place].view(np.int64), _rolled(hashes, words)[at].view(np.int64)


PASSAGE_UNITS = "rid long, start long, size int, anchor long, hash long, occ int"


def word_units(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From word_windows, for each unit (neighbouring windows with one anchor): its first window, its last one, its hash."""
    place, hashes = found[3], found[5].view(np.uint64)
    head = np.ones(len(place), bool)
    head[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    up, down = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return first, last, mix64((total[last + 1] - total[first]) * down[first] ^ (last - first).astype(np.uint64)).view(np.int64)


def _passage_units(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "raw"):
                data, offsets = flat(batch, "raw")
                found = word_windows(data, offsets, words)
                first, last, hashes = word_units(found)
                start, end, row, _, anchor, _ = found
                # Equal units that follow one another directly (periodic text) are one row with occ of them.
                new = np.ones(len(first), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (anchor[first[1:]] != anchor[first[:-1]]) | (row[first[1:]] != row[first[:-1]])
                run = np.flatnonzero(new)
                upto = np.append(run[1:], len(first))[: len(run)]
                first, last, hashes, occ = first[run], last[upto - 1], hashes[run], upto - run
                row = row[first]
                rid = batch.column(0).to_numpy(zero_copy_only=False)[row]
                cols = [pa.array(rid), pa.array(start[first] - offsets[row]), pa.array((end[last] - start[first]).astype(np.int32)), pa.array(anchor[first]), pa.array(hashes), pa.array(occ.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "start", "size", "anchor", "hash", "occ"])

    return run


def _unit_windows(words: int):
    """The windows of the units listed for a row, each as 2 * its start, plus one if it occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "raw"):
                data, offsets = flat(batch, "raw")
                found = word_windows(data, offsets, words)
                first, last, _ = word_units(found)
                start, end, row, _, _, hashes = found
                lists = batch.column(2).to_pylist()
                of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                listed = np.array([x for one in lists for x in one], np.int64)
                unit = np.searchsorted(start[first], offsets[of] + (listed >> 1))
                kind = np.zeros(len(first), np.int8)
                kind[unit] = 1 + (listed & 1)
                kind = np.repeat(kind, last - first + 1)
                at = np.flatnonzero(kind)
                start, size, row = start[at], (end - start)[at].astype(np.int32), row[at]
                rid = batch.column(0).to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start - offsets[row]), pa.array(size), pa.array(hashes[at]), pa.array(kind[at] == 2)], ["rid", "start", "size", "hash", "single"])

    return run


def repeated_passages(texts: DataFrame, words: int) -> DataFrame:
    """rid, start, size in bytes, from rid, raw: all stretches of `words` words that also stand elsewhere in the corpus.

    As with bytes: units whose anchor occurs once hold nothing repeated, equal units are settled by counting them, and
    of different units with a common anchor one each is cut to its windows, which are counted one by one.
    """
    units = materialise(texts.select("rid", "raw").transform(map_arrow, _passage_units(words), PASSAGE_UNITS), "passage-units")
    common = materialise(units.groupBy("anchor").agg(F.sum("occ").alias("n")).filter("n > 1").select("anchor"), "passage-common")
    shared = materialise(units.join(common, "anchor", "left_semi"), "passage-shared")
    counted = materialise(shared.groupBy("anchor", "hash").agg(F.sum("occ").alias("n"), F.min(F.struct("rid", "start")).alias("rep")), "passage-counted")
    settled = shared.join(counted.filter("n > 1").select("anchor", "hash"), ["anchor", "hash"], "left_semi").select("rid", "start", "size")
    several = materialise(counted.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "passage-several")
    wanted = counted.join(several, "anchor", "left_semi").select(F.col("rep.rid").alias("rid"), (2 * F.col("rep.start") + F.when(F.col("n") == 1, 1).otherwise(0)).alias("unit"))
    by_text = wanted.groupBy("rid").agg(F.collect_list("unit").alias("units"))
    found = texts.select("rid", "raw").join(by_text, "rid").select("rid", "raw", "units").transform(map_arrow, _unit_windows(words), "rid long, start long, size int, hash long, single boolean")
    found = materialise(found, "passage-windows")
    twice = materialise(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "passage-twice")
    return settled.unionByName(found.filter("single").join(twice, "hash", "left_semi").select("rid", "start", "size"))


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), with_text: bool = False, words: int | None = None, report: bool = False) -> DataFrame:
    """row (struct of the carried columns), n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept_text.

    Each byte that a MIN-byte string covers which also starts elsewhere in the corpus (this row or another) is
    removed, judged on the input. A null text is empty; texts of fewer than MIN bytes lose nothing; repeated rows are
    rows of their own, so both lose what they share; an empty table gives no rows. kept_text cuts at whole characters:
    a character that is only partly covered stays. With `words`, stretches of so many words (WORD_GRAM at least) that
    also stand elsewhere, with whatever white space between them, are removed as well, however few bytes they have;
    with `report`, these stay and n_passages (maximal runs of such stretches) and passage_bytes (bytes they cover,
    removed or not) tell of them.
    """
    texts = _bucketed(docs, carry)
    spans = repeated_spans(texts).withColumn("passage", F.lit(False))
    if words:
        # A span ends MIN - 1 bytes after the last of its windows, so a short passage has a negative number of them.
        passages = repeated_passages(texts, words).select("rid", "start", (F.col("size") - MIN + 1).alias("windows"), F.lit(True).alias("passage"))
        spans = spans.unionByName(passages)
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "windows", "passage")).alias("spans"))
    joined = texts.join(spans.withColumnRenamed("rid", "of"), F.col("rid") == F.col("of"), "left").select("row", "raw", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    kinds = f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_passages long, passage_bytes long" if report else "") + (", kept_text string" if with_text else "")
    return joined.transform(map_arrow, _digest(MIN, with_text, report), kinds)


def without_repeats(docs: DataFrame, words: int | None = None) -> DataFrame:
    """The rows of docs with text, and n_chars if there is one, less the repeated strings; null texts stay null."""
    out = remove_repeats(docs, tuple(docs.columns), with_text=True, words=words)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, **({"n_chars": F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
