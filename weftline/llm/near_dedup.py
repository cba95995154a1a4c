"""Near-duplicate groups by ProbMinHash, banding and exact verification.

Elements are shingles of five words (ASCII letters lower-cased; a shorter text is one shingle),
weighted by how often they occur. Each element is a Poisson process whose rate is its weight: its
arrivals fall into random registers, a register keeps the element that arrived first, and an element
stops as soon as its next arrival is later than every register of its text. Two texts agree in a
register with the probability Jaccard similarity of their weighted shingles. Runs of registers are
hashed into bands; texts that share a band are candidates. Links are defined on distinct shingles, so
every text is banded with all weights 1 as well: a passage that one of two texts repeats does not part them.

Texts with the same set of shingles are one class, and only one text of a class goes on. A bucket of
a few candidates is compared pair by pair; a larger one is linked as a star around its densest member
(the one in the fullest buckets), so a bucket of any size costs one pair a member. Where a star leaves
a bucket in several components, two members that are similar to each other but not to the leader must
share shingles that the leader lacks (or lie within it, and be of about its size): the bucket is dealt
anew by those shingles, as many as prefix filtering asks for with the rarest first, and the new
buckets are treated alike. What is still open and large after two turns is dealt by the shingles that half of a
bucket's members have, which lack nothing common as a leader with changes of its own does. No link is lost that way, and
copies that differ by edits of their own share no such shingle and cost nothing more. Pairs are
verified by the Jaccard similarity of their distinct shingles.

Defined cases: null and empty texts have no shingles and are groups of their own; repeated rows of
one identifier count once in grouping; a row without identifier gets the group of the texts with its
set of shingles that have one, else null; a group is named by its least identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, _byte_table, documents_only, materialise, mix, ranges_hash, settle, slices, tidy, without, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
_SLICE = 1 << 18  # keeps a worker's arrays to a few tens of MB
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ROOM = 50  # bits of a shingle hash beside its text's number
VOTERS = 64  # members, about, that name a large bucket's consensus; all members are dealt by it


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number << 50 | shingle hash, sorted and distinct; how often each occurs)."""
    starts, ends, first = words(data, offsets)
    h = ranges_hash(_byte_table(0)[_LOWER[data]], starts, ends, 0)
    count = np.diff(first)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), size)
    at = first[doc] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    g = ranges_hash(h, at, at + np.minimum(count[doc], SHINGLE), 0)
    key = np.sort(doc.astype(np.uint64) << np.uint64(_ROOM) | g >> np.uint64(64 - _ROOM))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.diff(np.append(head, len(key)))


def probminhash(element: np.ndarray, weight: np.ndarray, own: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the element that reaches each register first."""
    time = np.full(texts * registers, np.inf)
    first = np.zeros(texts * registers, np.uint64)
    t = np.zeros(len(element))
    rate = 1.0 / weight
    turn = 0
    while len(element):
        turn += 1
        u = ((mix(element + np.uint64(turn * int(_G1) % (1 << 64))) >> np.uint64(11)).astype(float) + 1) * 2.0**-53
        t = t - np.log(u) * rate
        at = own * registers + (mix(element ^ np.uint64(turn * int(_G2) % (1 << 64))) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(t < time[at])
        np.minimum.at(time, at[early], t[early])
        won = early[t[early] == time[at[early]]]
        first[at[won]] = element[won]
        alive, inverse = np.unique(own, return_inverse=True)
        latest = time.reshape(texts, registers)[alive].max(1)
        go = t < latest[inverse]
        element, t, rate, own = element[go], t[go], rate[go], own[go]
    return first.reshape(texts, registers)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands: hash of each band's number and registers."""
    sig = sig.reshape(len(sig), bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _G1
    for r in range(rows):
        keys = mix(keys + sig[:, :, r] * _G2)
    return keys


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << _ROOM) - 1)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in slices(batch, "text", _SLICE):
                n = hi - lo
                key, weight = shingles(data, offsets)
                own = (key >> np.uint64(_ROOM)).astype(np.int64)
                element = mix(key & low)
                size = np.bincount(own, minlength=n)
                edge = np.concatenate([[0], np.cumsum(size)])
                sums = []
                for x in (element, mix(element + _G2)):
                    c = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
                    sums.append(c[edge[1:]] - c[edge[:-1]])
                keys = _band_keys(probminhash(element, np.ones(len(element)), own, n, bands * rows), bands, rows)
                # by counts too, where a text repeats a shingle; bands that come out equal are listed once
                again = np.unique(own[weight > 1])
                picked = np.isin(own, again)
                counted = keys.copy()
                counted[again] = _band_keys(probminhash(element[picked], weight[picked].astype(float), np.searchsorted(again, own[picked]), len(again), bands * rows), bands, rows)
                both = np.concatenate([keys, counted], 1)
                listed = np.concatenate([np.ones(keys.shape, bool), counted != keys], 1)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(listed.sum(1))]).astype(np.int32)), pa.array(both[listed].view(np.int64)))
                yield pa.record_batch([ids.slice(lo, n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(size.astype(np.int32)), flat], names=["doc_id", "s1", "s2", "size", "bands"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            n = part.num_rows
            sides = []
            for side in ("text_a", "text_b"):
                keys = [shingles(data, offsets)[0] + (np.uint64(at) << np.uint64(_ROOM)) for at, _, data, offsets in slices(part, side, _SLICE)]
                sides.append(np.concatenate(keys) if keys else np.zeros(0, np.uint64))
            tally = lambda k: np.bincount((k >> np.uint64(_ROOM)).astype(np.int64), minlength=n)
            both = np.sort(np.concatenate(sides))
            size, common = tally(sides[1]), tally(both[1:][both[1:] == both[:-1]])
            same = common / np.maximum(tally(sides[0]) + size - common, 1)
            yield pa.record_batch([part.column("a"), part.column("b"), pa.array(same), pa.array(size.astype(np.int32)), pa.array(common.astype(np.int32))], names=["a", "b", "similarity", "size", "common"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity, size (of b), common of pairs; each side's text joins by its identifier."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(_compared), "a long, b long, similarity double, size int, common int")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64((1 << _ROOM) - 1)
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in slices(batch, "text", _SLICE):
            key, _ = shingles(data, offsets)
            yield pa.record_batch([pa.array(ids[lo:hi][(key >> np.uint64(_ROOM)).astype(np.int64)]), pa.array((key & low).astype(np.int64))], names=["doc", "x"])


def common_shingles(texts: DataFrame) -> DataFrame:
    """doc and shared: its shingles that another of these texts has too, rarest first."""
    every = materialise(texts.mapInArrow(tidy(_exploded), "doc long, x long"), "shingles")
    again = every.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = F.array_sort(F.collect_list(F.struct("n", "x")))
    return every.join(again, "x").groupBy("doc").agg(F.transform(rows, lambda r: r["x"]).alias("shared"))


class _Scale:
    """How small tables of up to ``rows`` rows are joined and written: below a bound they are broadcast
    (beyond it joins shuffle), and files hold a quarter of a million rows. After each, the driver collects
    garbage, so that its heap does not grow with the number of jobs."""

    def __init__(self, rows: int):
        self.files = max(6, rows // 250_000)
        self.near = F.broadcast if rows <= SMALL else lambda df: df

    def write(self, df: DataFrame, label: str) -> DataFrame:
        found = materialise(df.repartition(self.files), label)
        settle(df.sparkSession)
        return found


def _merged(known: DataFrame, links: DataFrame, scale: _Scale) -> DataFrame:
    """Components with more links (a, b): only those between two of ``known`` are followed, as links of these."""
    one = lambda side: scale.near(known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c")))
    named = scale.write(links.join(one("a"), "a", "left").join(one("b"), "b", "left").select("a", "b", F.coalesce("a_c", "a").alias("a_c"), F.coalesce("b_c", "b").alias("b_c")), "named")
    across = named.where("a_c <> b_c").select(F.col("a_c").alias("a"), F.col("b_c").alias("b")).distinct()
    if across.isEmpty():
        return known
    moved = components(across, scale).select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = known.unionByName(named.select(F.col("a").alias("node"), F.col("a_c").alias("component"))).unionByName(named.select(F.col("b").alias("node"), F.col("b_c").alias("component"))).distinct()
    return scale.write(nodes.join(scale.near(moved), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")


def components(links: DataFrame, scale: _Scale) -> DataFrame:
    """node, component (its least node) of the graph of links (a, b); labels spread and jump until none changes."""
    edges = scale.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scale.write(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("node"), "c"), "labels")
    while True:
        # a node takes the least label of its neighbours and of its own label's node
        near = edges.join(scale.near(label.select(F.col("node").alias("b"), "c")), "b").groupBy("a").agg(F.min("c").alias("m")).select(F.col("a").alias("node"), "m")
        jump = label.select(F.col("node").alias("c"), F.col("c").alias("j"))
        new = near.join(scale.near(label), "node").join(scale.near(jump), "c").select("node", F.least("m", "j", "c").alias("c2"), "c")
        new = scale.write(new, "labels")
        changed = not new.where("c2 <> c").isEmpty()
        label = new.select("node", F.col("c2").alias("c"))
        if not changed:
            return label.select("node", F.col("c").alias("component"))


def _open(buckets: DataFrame, comp: DataFrame | None, scale: _Scale) -> DataFrame:
    """key, doc, p, score, component, n (members) of the buckets that lie in more than one component
    and hold more than one p."""
    labelled = buckets.withColumn("component", F.col("doc")) if comp is None else buckets.join(scale.near(comp.withColumnRenamed("node", "doc")), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    ends = [f(c).alias(f"{c}_{i}") for c in ("component", "p") for i, f in ((0, F.min), (1, F.max))]
    keys = labelled.groupBy("key").agg(*ends, F.count(F.lit(1)).alias("n")).where("component_0 <> component_1 AND p_0 <> p_1").select("key", "n")
    return labelled.join(keys, "key").select("key", "doc", "p", "score", "component", "n")


def _extras(rel: DataFrame, known: DataFrame, shared: DataFrame, similarity: float, scale: _Scale) -> DataFrame:
    """key, doc, p for compared pairs (a: lead, b: doc, p): buckets by leader and shingle beyond it, or
    by lying within the leader.

    A partner of a text shares at least ceil(similarity * size) of its shingles, hence, beyond those
    in common with the leader, one of the first so many in any fixed order. Shingles of no other text
    come first in that order and need no bucket."""
    none = F.array().cast("array<long>")
    rel = scale.write(rel.join(known, ["a", "b"]), "led")  # read three times below
    lists = rel.join(shared.select(F.col("doc").alias("a"), F.col("shared").alias("sa")), "a", "left").join(shared.select(F.col("doc").alias("b"), F.col("shared").alias("sb")), "b", "left")
    sa, sb = F.coalesce("sa", none), F.coalesce("sb", none)
    need = F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int")
    beyond = F.array_except(sb, sa)
    first = F.size(sb) - need + 1  # the prefix less the shingles of no other text
    take = F.when(need > F.col("common"), F.greatest(F.lit(0), first)).otherwise(F.size(beyond))
    keys = lists.select("a", "b", "p", F.explode(F.slice(beyond, F.lit(1), take)).alias("x")).select(F.xxhash64("a", "x", F.col("p") == F.col("b")).alias("key"), F.col("b").alias("doc"), "p")
    # shingles of the leader alone can make b and a text of up to ``limit`` shingles similar. Texts like the
    # leader are of one component; another one meets those of them, and those others, that its limit allows
    limit = F.floor((1 + similarity) / similarity * F.col("common") + 1e-9) - F.col("size")
    sized = rel.select("a", "b", "p", "size", limit.alias("limit"), (F.col("similarity") >= similarity).alias("like"))
    ends = sized.groupBy("a").agg(F.min("size").alias("lo"), F.max(F.when(~F.col("like"), F.col("limit"))).alias("hi")).where("lo <= hi")
    within = sized.join(scale.near(ends), "a").where("IF(like, size <= hi, limit >= lo)")
    return keys.unionByName(within.select(F.xxhash64("a", F.lit("within"), F.col("p") == F.col("b")).alias("key"), F.col("b").alias("doc"), "p")).distinct()


def _dealt_anew(star: DataFrame, known: DataFrame, shared: DataFrame, similarity: float, scale: _Scale) -> DataFrame:
    """New buckets for stars (key, lead, doc) that stay open.

    Each text has a main leader: of those it was compared with, the one compared with most texts. Two texts of one main
    leader are settled by its extras alone (p is then the text itself, so all pairs count); only a
    bucket whose members have several is dealt by its own leader too, for the pairs across (p is the
    main leader). What several branches read is written, or the plan repeats it for each and outgrows the driver."""
    docs = star.select("doc").distinct()
    fame = known.groupBy("a").agg(F.count(F.lit(1)).alias("fame"))
    main = known.select("a", F.col("b").alias("doc")).join(scale.near(docs), "doc", "left_semi").join(scale.near(fame), "a")
    main = scale.write(main.groupBy("doc").agg(F.max_by("a", F.struct("fame", -F.col("a"))).alias("main")), "mains")
    own = main.select(F.col("main").alias("a"), F.col("doc").alias("b"), F.col("doc").alias("p"))
    tagged = star.join(scale.near(main), "doc")
    mixed = tagged.groupBy("key").agg(F.min("main").alias("m0"), F.max("main").alias("m1")).where("m0 <> m1").select("key")
    across = tagged.join(mixed, "key", "left_semi").select(F.col("lead").alias("a"), F.col("doc").alias("b"), F.col("main").alias("p")).distinct()
    found = scale.write(_extras(own.unionByName(across), known, shared, similarity, scale), "extras")
    more = found.groupBy("key").agg(F.min("p").alias("p0"), F.max("p").alias("p1")).where("p0 <> p1").select("key")
    return found.join(more, "key", "left_semi")


def _by_consensus(large: DataFrame, shared: DataFrame, sizes: DataFrame, similarity: float, scale: _Scale | None = None) -> DataFrame:
    """key, doc, p: buckets too large for pairs, dealt anew by the shingles that at least half of their members have.

    Leaders have changes of their own, so what they lack is common to all the others; the consensus of a
    bucket lacks nothing common. As with a leader, similar texts share one of
    the first shingles beyond it, or lie within it: then each one's size is at most the other's limit,
    so a text looks for partners in the bands of sizes (1 % wide) that its limit allows. This holds for any set of
    shingles, so about ``VOTERS`` members of a bucket name it for all: who votes changes the size of the new buckets and no link.
    Buckets of the same members are dealt once."""
    scale = scale or _Scale(large.count())
    members = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("h2")]
    once = large.groupBy("key").agg(*members).groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    named = scale.write(large.join(once, "key", "left_semi").select("key", "doc", "n").join(shared.select("doc"), "doc", "left_semi"), "members")
    voters = named.where(F.pmod(F.xxhash64("key", "doc"), F.greatest(F.lit(1), F.floor(F.col("n") / VOTERS))) == 0)
    votes = voters.groupBy("key").agg(F.count(F.lit(1)).alias("v"))
    often = voters.join(shared, "doc").select("key", F.explode("shared").alias("x")).groupBy("key", "x").agg(F.count(F.lit(1)).alias("m")).join(votes, "key").where("2 * m >= v")
    consensus = scale.write(often.groupBy("key").agg(F.collect_list("x").alias("u")), "consensus")
    rows = named.join(shared, "doc").join(sizes, "doc").join(consensus, "key", "left").withColumn("u", F.coalesce("u", F.array().cast("array<long>")))
    common, need = F.size(F.array_intersect("shared", "u")), F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int")
    limit = F.floor((1 + similarity) / similarity * common + 1e-9) - F.col("size")
    beyond, take = F.array_except("shared", "u"), F.when(need > common, F.greatest(F.lit(0), F.size("shared") - need + 1))
    rows = scale.write(rows.select("key", "doc", "size", limit.alias("limit"), F.slice(beyond, F.lit(1), F.coalesce(take, F.size(beyond))).alias("xs")), "judged")
    keys = rows.select("key", "doc", F.explode("xs").alias("x")).select(F.xxhash64("key", "x").alias("key"), "doc")
    ends = rows.groupBy("key").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    band = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(1.01))).cast("int")
    low, high = F.greatest(need, F.col("lo")), F.least("limit", "hi")
    inside = rows.join(ends, "key").where(low <= high)
    bands = F.array_distinct(F.concat(F.array(band(F.col("size"))), F.sequence(band(low), band(high))))
    within = inside.select("key", "doc", F.explode(bands).alias("band")).select(F.xxhash64("key", F.lit("within"), "band").alias("key"), "doc")
    return keys.unionByName(within).distinct().select("key", "doc", F.col("doc").alias("p"))


def groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, turns: int = 2, few: tuple[int, int] = (6, 48)) -> DataFrame:
    """doc_id, group_id for every row: group_id is the least identifier of the text's group.

    Buckets of at most ``few`` members (in the first turn, later) are compared pair by pair between
    components, larger ones as stars for ``turns`` turns; what is open then is dealt by consensus, as often, and compared pair by pair."""
    text = documents_only(docs)
    sig = materialise(text.mapInArrow(tidy(_signatures(bands, rows)), "doc_id long, s1 long, s2 long, size int, bands array<long>"), "signatures")
    scale = _Scale(sig.count())
    classes = sig.where("size > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = scale.write(classes, "classes")
    entry = classes.where("rep is not null").select(F.col("rep").alias("doc"), F.explode("bands").alias("key"))
    full = entry.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entry = scale.write(entry.join(full, "key"), "buckets")
    dense = scale.write(entry.groupBy("doc").agg(F.sum("n").alias("score")), "dense")
    scale = _Scale(dense.count())
    texts = materialise(text.join(scale.near(dense.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi").dropDuplicates(["doc_id"]).repartition(scale.files), "candidates")

    buckets, comp, known, shared = entry.select("key", "doc", F.col("doc").alias("p")), None, None, None
    for turn in range(turns + 1):
        rest = scale.write(_open(buckets.join(scale.near(dense), "doc"), comp, scale), "open")
        for _ in range(turns if turn == turns else 0):
            wide = rest.where(F.col("n") > few[1])
            if shared is None or wide.isEmpty():
                break
            sizes = sig.select(F.col("doc_id").alias("doc"), "size").join(scale.near(wide.select("doc").distinct()), "doc", "left_semi").groupBy("doc").agg(F.max("size").alias("size"))
            dealt = scale.write(_by_consensus(wide, shared, sizes, similarity, scale), "anew")
            narrow = rest.where(F.col("n") <= few[1]).select("key", "doc", "p", "score", "component", "n")
            rest = scale.write(narrow.unionByName(_open(dealt.join(scale.near(dense), "doc"), comp, scale)), "open")
        least = few[min(turn, 1)] if turn < turns else 1 << 62
        small, large = rest.where(F.col("n") <= least), rest.where(F.col("n") > least)
        other = small.select("key", F.col("doc").alias("doc2"), F.col("component").alias("component2"), F.col("p").alias("p2"))
        pairs = small.join(other, "key").where("doc < doc2 AND component <> component2 AND p <> p2").select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct()
        if known is not None:
            seen = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        star = None
        if turn < turns and not large.isEmpty():
            lead = large.groupBy("key").agg(F.max(F.struct("score", (-F.col("doc")).alias("d"))).alias("top")).select("key", (-F.col("top.d")).alias("lead"))
            star = scale.write(large.join(lead, "key").where("doc <> lead").select("key", "lead", "doc"), "stars")
            rays = star.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
            pairs = pairs.unionByName(rays if known is None else rays.join(known.select("a", "b"), ["a", "b"], "left_anti")).distinct()
        new = scale.write(compared(pairs, texts), "compared")
        if new.isEmpty() and star is None:
            break
        known = new if known is None else known.unionByName(new)
        alike = new.where(F.col("similarity") >= similarity)
        comp = components(alike, scale) if comp is None else _merged(comp, alike, scale)
        if star is None:
            break
        still = _open(large.select("key", "doc", "p", "score"), comp, scale).select("key").distinct()
        star = scale.write(star.join(still, "key", "left_semi"), "rays")
        if star.isEmpty():
            break
        if shared is None:  # later buckets hold only members of these, and their leaders
            held = star.select(F.col("doc").alias("doc_id")).union(known.select("a")).distinct()
            shared = scale.write(common_shingles(texts.join(scale.near(held), "doc_id", "left_semi")), "shared")
        buckets = scale.write(_dealt_anew(star, known, shared, similarity, scale), "dealt")
    if comp is None:
        comp = dense.select(F.col("doc").alias("node"), F.col("doc").alias("component"))
    reps = classes.join(scale.near(comp.withColumnRenamed("node", "rep")), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("group_id"))
    return sig.join(reps, ["s1", "s2"], "left").select("doc_id", F.when(F.col("size") > 0, F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose identifier names its group."""
    found = groups(docs).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    return without(docs, materialise(found.where("doc_id <> group_id").select("doc_id"), "dropped"))
