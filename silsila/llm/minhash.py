"""Near-duplicate groups: fast similarity sketches, banding, exact verification, connected components.

A document's set is its distinct word shingles. The sketch has T coordinates. In round i every element is thrown into
one coordinate by a hash and offers the value (i, hash); a coordinate keeps its least offer. Rounds go on until every
coordinate is filled; from round T on, coordinate i - T is offered every element, so 2T rounds always suffice, and the
number of agreeing coordinates of two sketches is concentrated around their sets' similarity.

Equal sets are one class from the start, so copies never multiply. Classes that share a band of the sketch are
candidates. A bucket is never expanded into all pairs: its members are compared with one hub, and verified links are
joined to components. Buckets that still hold several components connect families; there every class is compared
with the family's centre, and what two classes have in common beyond the centre bounds their similarity, so the links
that are left are found by prefix filtering on the differences. No link between candidates is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M64, chunks, flat, map_arrow, materialise, mix64, span_hashes, utf8, word_spans


@dataclass(frozen=True)
class Rule:
    """What makes two texts near copies: words a shingle, the least similarity in percent; and the sketch's bands and rows.

    A pair at the threshold t shares no band with a probability of (1 - t ** rows) ** bands: 7e-6 for the defaults.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5


_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes; A-Z are folded, fewer than k words make one shingle."""
    upper = (data >= 65) & (data <= 90)
    data = data + (upper.astype(np.uint8) << np.uint8(5))
    starts, ends, first = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled = mix64(rolled + h[j : j + len(rolled)] * np.uint64(2 * j + 3))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for j in range(a, b):
                short = mix64(short + h[j : j + 1] * np.uint64(2 * (j - a) + 3))
            out.append(mix64(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _seed(i: int) -> np.uint64:
    return np.uint64((i + 1) * 0xA0761D6478BD642F & M64)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A (len(sets), t) array of 64-bit coordinates; rows of empty sets stay at the largest value."""
    out = np.full(len(sets) * t, _NONE)
    sizes = np.array([len(s) for s in sets], np.int64)
    open_ = np.flatnonzero(sizes)
    for i in range(t):
        if not len(open_):
            break
        elements = np.concatenate([sets[d] for d in open_])
        x = mix64(elements + _seed(i))
        slot = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, np.repeat(open_ * t, sizes[open_]) + slot.astype(np.int64), (np.uint64(i) << np.uint64(32)) | (x & _LOW))
        open_ = open_[(out.reshape(-1, t)[open_] == _NONE).any(1)]
    rows = out.reshape(-1, t)
    for d in open_:
        for b in np.flatnonzero(rows[d] == _NONE):
            x = mix64(sets[d] + _seed(t + int(b)))
            rows[d, b] = (np.uint64(t + int(b)) << np.uint64(32)) | (x & _LOW).min()
    return rows


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """(n, bands) signed 64-bit bucket keys; the band's number is part of the key."""
    n, t = rows.shape
    parts = rows.reshape(n, bands, t // bands)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1).astype(np.uint64)), (n, bands)).copy()
    for j in range(t // bands):
        key = mix64(key ^ (parts[:, :, j] * np.uint64(0xE7037ED1A0B428DB)))
    return key.view(np.int64)


def _describe(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "raw"):
                sets = shingle_sets(*flat(batch, "raw"), rule.shingle)
                keys = band_keys(sketches(sets, rule.bands * rule.rows), rule.bands)
                n = np.array([len(s) for s in sets], np.int64)
                at = np.zeros(len(sets) + 1, np.int32)
                np.cumsum(np.where(n > 0, rule.bands, 0), out=at[1:])
                cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(cls, pa.binary()), bands], ["doc_id", "text_hash", "n_shingles", "cls", "bands"])

    return run


def _sets(rule: Rule):
    """cls and its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "raw"):
                want = batch.column(0).to_pylist()
                own = [(w, s.view(np.int64)) for s, w in zip(shingle_sets(*flat(batch, "raw"), rule.shingle), want, strict=True) if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == w]
                at = np.zeros(len(own) + 1, np.int32)
                np.cumsum([len(s) for _, s in own], out=at[1:])
                hashes = np.concatenate([s for _, s in own]) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes))], ["cls", "hashes"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    second = pairs.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("sb")), "b")
    both = second.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("sa")), "a")
    met = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return met.filter(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node reachable over links (a, b).

    Every node points to its least neighbour, if that is less than itself; pointers are followed to their ends, and the
    ends, at most half of the nodes, are the nodes of the next round. Links inside one end's tree are done and go, so a
    link is read in as many rounds as its ends stay apart, not in all.
    """
    edges, labels = materialise(_apart(links), "cc-edges"), None
    while True:
        up = edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")))
        ends = materialise(up.groupBy("node").agg(F.min("comp").alias("comp")).withColumn("old", F.lit(None).cast("binary")), "cc-ends")
        while True:
            jump = ends.select(F.col("node").alias("via"), F.col("comp").alias("end"))
            ends = materialise(ends.select("node", F.col("comp").alias("old")).join(jump, F.col("old") == F.col("via")).select("node", F.col("end").alias("comp"), "old"), "cc-ends")
            if ends.filter(F.col("old") != F.col("comp")).isEmpty():
                break
        step = ends.select(F.col("node").alias("via"), F.col("comp").alias("end"))
        labels = step.select(F.col("via").alias("node"), F.col("end").alias("comp")) if labels is None else materialise(labels.join(step, F.col("comp") == F.col("via"), "left").select("node", F.coalesce("end", "comp").alias("comp")), "cc-labels")
        first = edges.join(step.withColumnRenamed("via", "a"), "a").select(F.col("end").alias("a"), "b")
        edges = materialise(_apart(first.join(step.withColumnRenamed("via", "b"), "b").select("a", F.col("end").alias("b"))), "cc-edges")
        if edges.isEmpty():
            return labels


def _apart(links: DataFrame) -> DataFrame:
    """Distinct links between different nodes, the lesser node first."""
    return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, text_hash, n_shingles, component_id, kept, winner for every row of docs.

    component_id is the smallest id of the component; kept marks rows with that id; winner marks exactly one text of a
    component (the smallest id, then text hash). Texts that are null or have no word have n_shingles 0, are linked with
    nothing and are kept. A null id counts after all others: it is a component's id only if no member has one, and
    then the rows are kept by winner. Repeated rows are one class and get the same answer. Only doc_id and text are
    read. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8("text").alias("raw"))
    described = materialise(own.transform(map_arrow, _describe(rule), "doc_id long, text_hash long, n_shingles long, cls binary, bands array<long>"), "near-described")
    some = described.filter(F.col("cls").isNotNull())
    ident = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("text_hash"))
    classes = materialise(some.groupBy("cls").agg(F.min(ident).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "near-classes")
    in_buckets = classes.select("cls", "n", "rep", F.explode("bands").alias("bucket"))
    shared = materialise(in_buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "near-buckets")
    members = materialise(in_buckets.join(shared, "bucket"), "near-members")
    # The hub is the class that meets most others in all its buckets: the same one in most buckets of a group, so few pairs.
    fame = members.groupBy("cls").agg(F.sum("members").alias("fame"))
    hubs = members.join(fame, "cls").groupBy("bucket").agg(F.max(F.struct("fame", "cls", "n")).alias("x")).select("bucket", F.col("x.cls").alias("hub"), F.col("x.n").alias("hub_n"))
    members = materialise(members.join(materialise(hubs, "near-hubs"), "bucket").select("bucket", "cls", "n", "rep", "hub", "hub_n"), "near-members")
    links = _link(docs, members, rule)
    labels = classes.select("cls", "rep")
    if links is not None:
        found = components(links)
        labels = labels.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        labels = materialise(labels, "near-comps")
        least = materialise(labels.groupBy("comp").agg(F.min("rep").alias("first")), "near-least")
        labels = materialise(labels.join(least, "comp").select("cls", "first"), "near-labels")
    else:
        labels = labels.withColumnRenamed("rep", "first")
    none = F.lit((1 << 63) - 1)
    out = described.join(labels.withColumnRenamed("cls", "own"), F.col("cls") == F.col("own"), "left")
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.when(F.col("first.id") != none, F.col("first.id")))
    winner = F.col("first").isNull() | (F.col("first") == ident)
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), winner.alias("winner")).select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("winner")).alias("kept"), "winner")


def _link(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame | None:
    """Verified links that connect everything connected among the members of shared buckets; None if there is no bucket."""
    pairs = materialise(members.filter((F.col("cls") != F.col("hub")) & _close(F.col("n"), F.col("hub_n"), rule.percent)).select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "near-pairs")
    if members.isEmpty():
        return None
    wanted = members.select("cls", F.col("rep.id").alias("id"), F.col("rep.text_hash").alias("h")).distinct()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("h"), utf8("text").alias("raw"))
    sets = materialise(texts.join(wanted, ["id", "h"]).select("cls", "raw").transform(map_arrow, _sets(rule), "cls binary, hashes array<long>").dropDuplicates(["cls"]), "near-sets")
    links = materialise(verify(pairs, sets, rule.percent), "near-links")
    found = components(links)
    placed = members.select("bucket", "cls", "hub", "n").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    # Tables of their own, here and below: Spark can then split the hot keys of the joins with them.
    mixed = materialise(placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("bucket"), "near-mixed")
    rest = materialise(placed.join(mixed, "bucket").select("cls", "hub", "n", "comp").distinct(), "near-rest")
    if rest.isEmpty():
        return links
    # Families: classes that buckets with several components connect, whether linked or not.
    families = components(rest.filter("cls != hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")))
    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("degree"))
    people = rest.select("cls", "n", "comp").distinct().join(families.select(F.col("node").alias("cls"), F.col("comp").alias("family")), "cls").join(degree, "cls", "left")
    people = materialise(people.select("cls", "n", "comp", "family", F.coalesce("degree", F.lit(0)).alias("degree")), "near-family")
    centre = materialise(people.groupBy("family").agg(F.min(F.struct(-F.col("degree"), F.col("cls"), F.col("comp"))).alias("x")).select("family", F.col("x.cls").alias("centre"), F.col("x.comp").alias("centre_comp")), "near-centres")
    around = people.join(centre, "family").filter("cls != centre")
    more, last = _around(around, sets, rule.percent)
    return materialise(links.unionByName(more).unionByName(last), "near-links")


def _close(x, y, percent: int):
    """Whether the sizes alone allow a link."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _around(around: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to the centres of families, and links between a class that its centre does not link and any other.

    Let h be the centre, and let x add a and lack r of its elements. With s differences in common, x and y share
    |h| - r_x - r_y + s of |h| + a_x + a_y - s elements. So a link needs s >= (q_x + t a_y + r_y) / (1 + t), where t is
    the threshold and q_x = t (|h| + a_x) - |h| + r_x, which is above 0 if h does not link x. A difference that only one
    class of the family has is never in common. That rules out almost all classes by counting; the others are paired
    at the first of their rarest differences in common, as many of those as the bound requires (prefix filtering), if
    the differences from there on can still reach the bound (positional filtering).
    """
    t = percent / 100
    x_set = sets.select("cls", F.col("hashes").alias("sx"))
    c_set = sets.select(F.col("cls").alias("centre"), F.col("hashes").alias("sc"))
    met = around.join(x_set, "cls").join(c_set, "centre").select("family", "cls", "comp", "centre_comp", "centre", F.size("sc").alias("h"), F.array_except("sx", "sc").alias("a"), F.array_except("sc", "sx").alias("r"))
    # A hash that one class adds is not of the centre, one that another lacks is: the two kinds never mix.
    seen = met.select("family", "cls", "comp", "centre_comp", "centre", "h", F.size("a").alias("added"), F.size("r").alias("lacks"), F.concat("a", "r").alias("diff"))
    seen = materialise(seen.withColumn("linked", 100 * (F.col("h") - F.col("lacks")) >= percent * (F.col("h") + F.col("added"))), "near-differences")
    # What the centre links is of its component now; pairs inside a component need no look.
    seen = seen.withColumn("comp", F.when(F.col("linked"), F.col("centre_comp")).otherwise(F.col("comp")))
    links = seen.filter("linked").select(F.col("centre").alias("a"), F.col("cls").alias("b"))
    each = seen.select("family", "cls", F.explode("diff").alias("d"))
    shared = materialise(each.groupBy("family", "d").agg(F.count("*").alias("df")).filter("df > 1"), "near-shared")
    common = materialise(each.join(shared, ["family", "d"]), "near-common")
    ranked = common.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "d"))).alias("shared"))
    facts = seen.select("family", "cls", "comp", "linked", "h", "added", "lacks", (F.lit(t) * (F.col("h") + F.col("added")) - F.col("h") + F.col("lacks")).alias("q")).join(ranked, "cls")
    size_d, own = F.col("added") + F.col("lacks"), F.size("shared")
    # As the other side of an unlinked x: more than half of the differences must be in common.
    need_y = (F.lit(t) * F.col("added") + F.col("lacks")) / (1 + t)
    keep = lambda need: F.greatest(F.lit(0), size_d - F.ceil(need - 1e-9) + 1 - (size_d - own)).cast("int")  # noqa: E731  of the prefix what is shared at all
    size = (F.col("h") - F.col("lacks") + F.col("added")).alias("n")
    # A posting of e carries its place in the class's order and what stands before it there.
    y = facts.filter(own >= need_y - 1e-9).select("family", "cls", "comp", "q", "added", "lacks", size, "shared", F.posexplode(F.slice("shared", F.lit(1), keep(need_y))).alias("at", "e"))
    y = y.select("family", "e", "cls", "comp", "added", "lacks", "n", (F.size("shared") - F.col("at")).alias("left"), F.slice("shared", F.lit(1), F.col("at")).alias("before"))
    x = facts.filter(~F.col("linked") & (own >= F.col("q") - 1e-9)).select("family", "cls", "comp", "q", size, "shared", F.posexplode(F.slice("shared", F.lit(1), keep(F.greatest(F.col("q"), F.lit(1.0))))).alias("at", "e"))
    x = x.select("family", "e", F.col("cls").alias("x"), F.col("comp").alias("comp_x"), F.col("q").alias("qx"), F.col("n").alias("n_x"), (F.size("shared") - F.col("at")).alias("left_x"), F.slice("shared", F.lit(1), F.col("at")).alias("before_x"))
    need = (F.col("qx") + F.lit(t) * F.col("added") + F.col("lacks")) / (1 + t)
    # A pair is made once, at its first common difference, and only if what stands behind that one can suffice.
    first = ~F.arrays_overlap("before_x", "before")
    met = x.join(y, ["family", "e"]).filter((F.col("comp_x") != F.col("comp")) & (F.least("left", "left_x") >= need - 1e-9) & _close(F.col("n_x"), F.col("n"), percent) & first)
    pairs = materialise(met.select(F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b")).distinct(), "near-pairs")
    return links, verify(pairs, sets, percent)


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The rows of docs, all their columns, less all but one row of each component.

    Rows whose text has no word are linked with nothing, so all of them stay.
    """
    answer = near_duplicates(docs, rule)
    some = answer.filter("winner and n_shingles > 0").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), F.col("text_hash").alias("_h")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64("text").alias("_h"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words"))
    kept = named.filter("_words").join(some, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
    out = kept.select("row").unionByName(named.filter("not _words").select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
