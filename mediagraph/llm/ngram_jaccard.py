"""N-gram Jaccard join (operator 6): documents whose sets of 4-word shingles overlap by 0.85 or more, through a token-group matrix.

1. Scan: each text becomes a set of 64-bit shingle hashes, of which a short row is kept: size, set hash, four minimum hashes and a
   bitmap of about two bits per shingle. Equal sets are one set from here on.
2. Members in common: all shingles are dealt once by hash, 4 bytes each, packed by set and bucket; each bucket tells how many of a set's
   shingles another set has too. A set with fewer than 0.85 n of them links with nothing and is left out.
   Postings: the sets left are rebuilt and their shingles counted among them, exactly. Two sets that link share one of their first
   `n - ceil(0.85 n) + 1` shingles from rare to common; of these, those that one set alone has come first and are not posted.
3. Groups: sets with a minimum hash in common are compared with the one of them that has the fewest members of its own; the links found make the first clusters, and
   each cluster is cut into groups of at most 64 sets.
4. Matrix: the postings give, for each query set, the groups of other clusters that hold one of its first shingles (with sizes and
   places that allow a link). Each group row holds the union of its members' bitmaps; it bounds the overlap with any member, and only
   groups whose bound reaches the threshold are opened, where each member's own bitmap bounds it again.
5. Check: what is left is compared on full sets, a few pairs per query and cluster at first, the rest only while the two are still apart.
   So no link between clusters is lost, and a large group of near copies doesn't give all its pairs.

Full sets are rebuilt once, from the text of just the documents in question, told by a bitmap of bounded size. Nothing per document is collected.

Defined cases: null texts and texts without words have no set and link with nothing (their own component); fewer than four words are one
shingle; repeated rows and rows of one id are rows of their own with equal sets; a null id takes part, and is the component only if no
member has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mediagraph.llm import words
from mediagraph.llm.components import components
from mediagraph.llm.wanted import split
from mediagraph.session import cut

SHINGLE, PERCENT = 4, 85
#: Shingles of a bucket, buckets at least, shingles of a task dealt at a time, members of a group.
BUCKET, LEAST_BUCKETS, DEALT, GROUP = 1 << 21, 64, 1 << 20, 64
KEYS = ("key0", "key1", "key2", "key3")
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a piece, letters A-Z lowered."""
    low = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << np.uint8(5))
    starts, ends, word_at = words.word_spans(low, offsets)
    h = words.hash_spans(low, starts, ends)
    grams, out = words.window_hashes(h, size), []
    for a, z in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(grams[a : z - size + 1]))
        else:
            out.append(words.window_hashes(h[a:z], z - a) ^ np.uint64(z - a) if z > a else np.zeros(0, np.uint64))
    return out


def batch_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    buf, offsets = words.text_buffer(column)
    for i, j in words.pieces(offsets):
        yield from shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)


def set_hash(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bits of the set, two to four times as many as it has members (a power of two)."""
    bits = np.zeros(max(64, 1 << int(2 * len(tokens) - 1).bit_length()), bool)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The same bitmap over fewer bits (of `size` bytes)."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


def prefix_size(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def enough(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def described(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc, th, n, sig, keys, bits) of every text of (doc, th, text)."""
    schema = "doc bigint, th bigint, n bigint, sig bigint, " + "".join(f"{k} bigint, " for k in KEYS) + "bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, keys, bits = [], [], [], []
            for tokens in batch_sets(batch.column(2), size):
                n.append(len(tokens))
                if not len(tokens):
                    sig.append(None), keys.append([None] * 4), bits.append(None)
                    continue
                sig.append(set_hash(tokens))
                keys.append([int((tokens * f).min().view(np.int64)) for f in FACTORS])
                bits.append(bitmap(tokens).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(4)),
                pa.array(bits, pa.binary())], ["doc", "th", "n", "sig", *KEYS, "bits"])

    return docs.mapInArrow(run, schema)


def members_in_common(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """(sig, shared): how many of a set's members another set has too, or a few more where half a hash is the same; never fewer."""

    def packed(sets: list[np.ndarray], sigs: list[int]) -> pa.RecordBatch:
        tokens, own = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, own, low = bucket[order], own[order], tokens[order].astype(np.uint32)
        used, at = np.unique(bucket, return_index=True)
        runs = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
        several = np.diff(np.append(np.searchsorted(runs, at), len(runs)))
        return pa.RecordBatch.from_arrays([
            pa.array(used), words.blobs(np.array(sigs, np.int64)[own[runs]], several), words.blobs(np.diff(np.append(runs, len(own))).astype(np.int32), several),
            words.blobs(low, np.diff(np.append(at, len(low))))], ["bucket", "sigs", "sizes", "low"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, sets, sigs, held = set(), [], [], 0
            for tokens in batch_sets(batch.column(0), size):
                if not len(tokens) or (sig := set_hash(tokens)) in seen:
                    continue
                seen.add(sig), sets.append(tokens), sigs.append(sig)
                held += len(tokens)
                if held >= DEALT:
                    yield packed(sets, sigs)
                    sets, sigs, held = [], [], 0
            if sets:
                yield packed(sets, sigs)
        words.give_back()

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        sigs, sizes, low = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("sigs", np.int64), ("sizes", np.int32), ("low", np.uint32)))
        own = np.repeat(np.arange(len(sigs)), sizes)
        once = np.zeros(len(sigs), bool)  # a set may come from several batches
        once[np.unique(sigs, return_index=True)[1]] = True
        own, low = own[once[own]], low[once[own]]
        order = np.argsort(low)
        same = np.concatenate(([False], np.diff(low[order]) == 0, [False]))
        found, n = np.unique(sigs[own[order[same[1:] | same[:-1]]]], return_counts=True)
        return pa.table({"sig": pa.array(found), "shared": pa.array(n.astype(np.int64))})

    rows = docs.select("text").mapInArrow(dealt, "bucket int, sigs binary, sizes binary, low binary")
    return rows.groupBy("bucket").applyInArrow(counted, "sig bigint, shared bigint").groupBy("sig").agg(F.sum("shared").alias("shared"))


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by the first one, cut only where its value changes."""
    held = []
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        if held and held[0][0][0] == now[0][-1]:
            held.append(now)
            continue
        done = int(np.searchsorted(now[0], now[0][-1]))
        if held or done:
            yield [np.concatenate(x) for x in zip(*held, [x[:done] for x in now], strict=True)]
        held = [[x[done:] for x in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def run_sizes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return first, np.diff(np.append(first, len(values)))


def postings(full: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, at) of the first shingles of each set (sig, tokens), rare ones first, without those that one set alone has."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                raw, at = words.text_buffer(part.column(1))
                n = np.diff(at) // 8
                sig = np.repeat(part.column(0).to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.tobytes(), np.int64)), pa.array(sig), pa.array(np.repeat(n, n).astype(np.int32))], ["token", "sig", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, sig, n in whole_runs(batches):
            several = np.repeat(counts := run_sizes(token)[1], counts)
            keep = several > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, several, token, n)], ["sig", "several", "token", "n"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, _, token, n in whole_runs(batches):
            begin, counts = run_sizes(sig)
            at = n - np.repeat(begin + counts, counts) + np.arange(len(sig))  # those of its own stand before
            keep = at < prefix_size(n, percent)
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(sig[keep]), pa.array(n[keep]), pa.array(at[keep].astype(np.int32))], ["token", "sig", "n", "at"])

    rows = full.select("sig", "tokens").mapInArrow(members, "token bigint, sig bigint, n int")
    rows = rows.repartition("token").sortWithinPartitions("token").mapInArrow(shared, "sig bigint, several bigint, token bigint, n int")
    return rows.repartition("sig").sortWithinPartitions("sig", "several", "token").mapInArrow(first, "token bigint, sig bigint, n int, at int")


def overlap_bound(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """At most so many members do two sets share, by their bitmaps."""
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def star_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with one of those that have its minimum hash, where sizes and bitmaps allow a link: the one with the fewest
    members that no other set has. Of near copies of one text this is the nearest to it, which links with most of them."""
    found = None
    for key in KEYS:
        pivot = sets.groupBy(key).agg(F.min(F.struct("alone", "sig", "n", "bits")).alias("pivot"), F.count(F.lit(1)).alias("several")).where("several > 1")
        rows = sets.join(pivot, key).where("sig <> pivot.sig").select("pivot.sig", "sig", "pivot.n", "n", "pivot.bits", "bits").toDF("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        found = rows if found is None else found.union(rows)
    sized = found.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            bits = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(i)] for i in (4, 5)]
            keep = [bool(enough(overlap_bound(a, p, b, q), p, q, percent)) for a, b, p, q in zip(*bits, n_a.tolist(), n_b.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.mapInArrow(run, "a bigint, b bigint").distinct()


def full_sets(docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(sig, tokens) of `sets`, rebuilt from the texts (th, text) of just those."""
    wanted = sets.select("sig", "th")
    some, _ = split(docs.select("th", "text"), "th", wanted.select("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(th, set_hash(x)): x.tobytes() for th, x in zip(batch.column(0).to_pylist(), batch_sets(batch.column(1), size), strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.binary())], ["th", "sig", "tokens"])

    rebuilt = some.mapInArrow(run, "th bigint, sig bigint, tokens binary")
    return cut(rebuilt.join(wanted, ["th", "sig"]).dropDuplicates(["sig"]).select("sig", "tokens"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that link, by their full sets."""
    rows = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("tokens_a")), "a").join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tokens_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((a, b)), kind="stable")
                keep.append(bool(enough(int((both[1:] == both[:-1]).sum()), len(a), len(b), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a bigint, b bigint")


def grouped(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(sig, cluster, members, part): the cluster of each set (itself if alone), its size, and the group that the set is in."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    known = clusters.join(sizes, "component").withColumn("part", F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / GROUP))))
    return sets.join(known, sets["sig"] == known["node"], "left").select(
        "sig", "n", "bits", F.coalesce("component", "sig").alias("cluster"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("part", "sig").alias("part"))


def matrix_hits(posted: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(q, part): query sets and the groups of other clusters that hold one of their first shingles. Of two sets the one in the smaller
    cluster asks."""

    def pairs(token, sig, n, at, cluster, members, part) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        i = np.arange(len(token))
        for step in range(1, len(token)):
            i = i[i + step < len(token)]
            i = i[token[i] == token[i + step]]
            if not len(i):
                break
            j = i + step
            most = 1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1)
            good = (cluster[i] != cluster[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & enough(most, n[i], n[j], percent)
            a, b = i[good], j[good]
            asks = (members[a] < members[b]) | ((members[a] == members[b]) & (cluster[a] < cluster[b]))
            found.append((np.where(asks, sig[a], sig[b]), np.where(asks, part[b], part[a])))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches):
            first, counts = run_sizes(rows[0])
            mixed = np.repeat(np.minimum.reduceat(rows[4], first) < np.maximum.reduceat(rows[4], first), counts)  # more than one cluster has it
            yield hits([x[mixed] for x in rows])

    def hits(rows: list[np.ndarray]) -> pa.RecordBatch:
        q, part = pairs(*rows)
        once = np.unique(np.stack([q, part], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["q", "part"])

    rows = posted.join(groups.drop("n", "bits"), "sig").select("token", "sig", "n", "at", "cluster", "members", "part")
    rows = rows.withColumn("n", F.col("n").cast("bigint")).withColumn("at", F.col("at").cast("bigint"))
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "q bigint, part bigint").distinct()


def opened(hits: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(q, part, asked): the groups whose union of shingles lets a query reach the threshold, with the members whose own bitmaps do,
    best first."""
    held = groups.groupBy("part").agg(F.collect_list(F.struct("sig", "n", "bits")).alias("held"))
    rows = hits.join(groups.select(F.col("sig").alias("q"), "n", "bits"), "q").join(held, "part").select("q", "part", "n", "bits", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = []
            for n, raw, held in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                own, good = np.frombuffer(raw, np.uint8), []
                members = [(m["sig"], m["n"], np.frombuffer(m["bits"], np.uint8)) for m in held.as_py()]
                size = min(len(own), min(len(m[2]) for m in members))
                union = np.bitwise_or.reduce([fold(m[2], size) for m in members], axis=0)
                if 100 * (n - int(np.bitwise_count(fold(own, size) & ~union).sum())) >= percent * n:
                    for sig, m, bits in members:
                        most = overlap_bound(own, n, bits, m)
                        if enough(most, n, m, percent):
                            good.append((-most / (n + m - most), sig))
                asked.append([sig for _, sig in sorted(good)])
            keep = pa.array([len(x) > 0 for x in asked], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(asked, pa.list_(pa.int64()))], ["q", "part", "asked"]).filter(keep)

    return rows.mapInArrow(run, "q bigint, part bigint, asked array<bigint>")


def still_apart(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Open questions (q, part, asked) whose two sides are in different clusters by now, with both clusters."""
    of = lambda name: clusters.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(name))
    rows = rows.join(of("mine"), F.col("q") == F.col("mine_node"), "left").join(of("theirs"), F.col("asked")[0] == F.col("theirs_node"), "left")
    return rows.select("q", "part", "asked", F.coalesce("mine", "q").alias("mine"), F.coalesce("theirs", F.col("asked")[0]).alias("theirs")).where("mine <> theirs")


def linked_sets(full: DataFrame, sets: DataFrame, posted: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that link with another."""
    edges = cut(linked(star_pairs(sets, percent), full, percent))
    clusters = cut(components(edges))
    groups = cut(grouped(sets, clusters))
    ask = cut(opened(matrix_hits(posted, groups, percent), groups, percent))
    if ask.isEmpty():
        return clusters
    many = 1
    while True:
        rows = cut(still_apart(ask, clusters))
        if rows.isEmpty():
            return clusters
        turn = F.row_number().over(Window.partitionBy("q", "theirs").orderBy("part"))
        now = cut(rows.withColumn("turn", turn <= many))
        pairs = now.where("turn").select(F.col("q").alias("a"), F.explode(F.slice("asked", 1, 4 * many)).alias("b"))
        edges = cut(edges.union(linked(pairs, full, percent)))
        clusters = cut(components(edges))
        ask = now.select("q", "part", F.when(F.col("turn"), F.slice("asked", 4 * many + 1, 1 << 30)).otherwise(F.col("asked")).alias("asked")).where("size(asked) > 0")
        many *= 4


def clustered(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, n, component) of every row: its id, the hash of its text, the set's size, and what links lead to (null without a set)."""
    own = docs.select(F.col(id_col).cast(LongType()).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    rows = cut(described(own, size))
    sets = cut(rows.where("n > 0").groupBy("sig").agg(F.min("th").alias("th"), F.first("n").alias("n"), *[F.first(k).alias(k) for k in KEYS], F.first("bits").alias("bits")))
    buckets = max(LEAST_BUCKETS, (rows.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    able = members_in_common(own, buckets, size).join(sets, "sig").where(f"100 * shared >= {percent} * n")
    sets = cut(able.withColumn("alone", F.col("n") - F.col("shared")).drop("shared"))
    full = full_sets(own, sets, size)
    posted = cut(postings(full, percent))
    clusters = linked_sets(full, sets, posted, percent)
    return rows.select("doc", "th", "n", "sig").join(clusters, F.col("sig") == F.col("node"), "left").select("doc", "th", "n", F.coalesce("component", "sig").alias("component"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the set's size and the smallest id that links lead to."""
    named = clustered(docs, size, percent, id_col, text).select("doc", "n", "component")
    least = named.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"))
    return named.join(least, "component", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"))
