"""Near-duplicate documents by MinHash with tensored banding, every link verified on full shingle sets.

Two collections A and B of m short bands (k minhashes each) give m * m table keys, one for each pair (A_i, B_j):
2 * m * k minhashes stand in for the m * m * 2k that as many independent tables would need. Two documents of
similarity s meet in some table with probability (1 - (1 - s^k)^m)^2. For k = 4, m = 18 that is 0.998 at 0.75, 0.9999 at 0.8,
and for unlike ones 0.02 at 0.3, 0.0008 at 0.2, 0.000003 at 0.1.

Equal sets are one class from the start. Within a table key only a star is followed first (each document with the
smallest). After verification, table keys of three documents or more that still hold several components are taken up again:
there every document outside the largest component is held against all others, by counting shared shingles in an inverted
index. That is done key by key where keys are sparse, and once for a whole cluster of keys where they overlap so much that this is less
work (as in a family of texts that share most of their keys). So components are those of all pairs that share a key, without
pairing a group of copies with itself, and texts that have little in common do not become one group to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, fresh, materialise, ship, tasks_for
from .components import connected_components
from .meeting import SENT, bucket_count, meet, send
from .wordhash import U, Words, mix, runs

K, M, SHINGLE, PERCENT = 4, 18, 5, 75
#: Shingles on each side of a cell in which components are held against each other, or one text's if that has more; and into how many blocks a
#: side of a sixteenth of that for each is cut even so, that one group does not become one task.
BLOCK, SPREAD = 512 << 10, 8


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, sorted; a text of fewer words is one shingle."""
    at, h = words.windows(size)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        own = []
        for d in short:
            x = U(words.count[d])
            for w in words.hash[words.first[d] : words.first[d + 1]]:
                x = mix(np.array([x ^ w]))[0]
            own.append(x)
        doc, h = np.concatenate((doc, short)), np.concatenate((h, np.array(own, U)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def _set_hashes(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have shingles, where each starts, and a 128-bit hash of each set."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    start = np.flatnonzero(new)
    both = np.stack([mix(np.add.reduceat(mix(h ^ U(s)), start)) for s in (0x5BD1E995, 0x27D4EB2F)], 1) if len(start) else np.zeros((0, 2), U)
    return doc[start], start, np.ascontiguousarray(both)


def _keys(signature: np.ndarray, m: int) -> np.ndarray:
    """Rows of m * m table keys from rows of 2 * m bands."""
    a, b = signature[:, :m, None], signature[:, None, m:]
    return mix((a * U(0x9E3779B97F4A7C15) ^ b) + np.arange(m * m, dtype=np.int64).astype(U).reshape(m, m) * U(0xC2B2AE3D27D4EB4F)).reshape(len(signature), -1)


def signatures(docs: DataFrame, shingle: int = SHINGLE, k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_shingles, set_hash (null without words) and signature (2 * m packed bands) of (doc_id, text) rows."""
    ship(docs.sparkSession)
    mult = (_rng_values(2 * m * k, 1) | U(1)).reshape(2 * m, k)
    add = _rng_values(2 * m * k, 2).reshape(2 * m, k)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, _ in runs(batch, lower=True):
                doc, h = _shingles(words, shingle)
                own, start, both = _set_hashes(doc, h)
                bands = np.zeros((len(own), 2 * m), U)
                if len(own):
                    for i in range(2 * m):
                        for j in range(k):
                            bands[:, i] = mix(bands[:, i] ^ np.minimum.reduceat(h * mult[i, j] + add[i, j], start))
                n = np.bincount(doc, minlength=b - a)
                sets, sigs = [None] * (b - a), [None] * (b - a)
                for i, d in enumerate(own):
                    sets[d], sigs[d] = both[i].tobytes(), bands[i].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_hash binary, signature binary")


def _rng_values(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([8, seed]).integers(0, 2**63, n, dtype=np.int64).astype(U) * U(2) + U(seed)


def _signed_keys(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches of (doc_id, signature, ...) with the table keys of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield part, _keys(np.frombuffer(b"".join(part.column(1).to_pylist()), U).reshape(part.num_rows, -1), m)


def _stars(reps: DataFrame, m: int, n: int) -> DataFrame:
    """(smallest, other) of each table key's documents; n: buckets. Keys are told apart by their bucket and 32 bits: what meets is verified."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys in _signed_keys(batches, m):
            yield send(keys.ravel(), np.repeat(part.column(0).to_numpy(), keys.shape[1]), n, "star", False)

    return meet(reps.select("doc_id", "signature").mapInArrow(tables, SENT), "star", False).distinct()


def _sets(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The sorted shingle hashes of some class representatives (a written table of doc_id and set_hash), from their texts. Where they are
    few, they are sent to the texts, and no text is exchanged."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            for a, b, words, _ in runs(batch, lower=True):
                doc, h = _shingles(words, shingle)
                own, start, both = _set_hashes(doc, h)
                end = np.append(start[1:], len(h))
                rows = [(a + int(d), h[x:y].tobytes()) for d, x, y, z in zip(own, start, end, both, strict=True) if z.tobytes() == wanted[a + d]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([len(r[1]) // 8 for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "n", "shingles"])

    return docs.join(F.broadcast(nodes) if few(nodes) else nodes, "doc_id").select("doc_id", "text", "set_hash").mapInArrow(build, "doc_id long, n long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    return pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def _keyed(members: DataFrame, m: int) -> DataFrame:
    """key, doc_id, component, cluster, n of documents (doc_id, signature, component, cluster, n) for each of their table keys."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys in _signed_keys(batches, m):
            own = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(part.column(i).take(own) for i in (0, 2, 3, 4))], names=["key", "doc_id", "component", "cluster", "n"])

    return members.select("doc_id", "signature", "component", "cluster", "n").mapInArrow(tables, "key long, doc_id long, component long, cluster long, n long")


def _groups(members: DataFrame, m: int, tasks: int, short: int) -> DataFrame:
    """group (level and id), doc_id, component, n: the documents (doc_id, signature, component, cluster, n: shingles) that are to be held against each other.

    Open are the keys that hold three documents or more and more than one component; keys with the same documents count once. Where holding
    a cluster's documents against each other once is no more work than doing so for each of its open keys, the cluster is one group;
    else each open key is one.
    """
    keyed = _keyed(members, m)
    each = keyed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("doc_id")).alias("same"), F.min("cluster").alias("cluster"))
    per = each.groupBy("key").agg(F.sum("members").alias("members"), F.count(F.lit(1)).alias("components"), F.bit_xor("same").alias("same"), F.min("cluster").alias("cluster"))
    open_ = materialise(per.where("members > 2 and components > 1").groupBy("cluster", "members", "same").agg(F.min("key").alias("key")), "keys", short)
    work = open_.groupBy("cluster").agg(F.sum(F.col("members").cast("double") * F.col("members")).alias("work"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("size"))
    work = materialise(work.join(sizes, "cluster").select("cluster", (F.col("size") * F.col("size") <= F.col("work")).alias("dense")), "work", short)
    group = lambda level, c: F.struct(F.lit(level).alias("level"), F.col(c).alias("id")).alias("group")
    whole = members.join(work.where("dense"), "cluster").select(group(0, "cluster"), "doc_id", "component", "n")
    sparse = open_.join(work.where("not dense"), "cluster").select("key")
    return materialise(whole.unionByName(keyed.join(sparse, "key").select(group(1, "key"), "doc_id", "component", "n")), "groups", tasks)


def _across(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a group, at least one for each document and component it links to.

    Documents outside a group's largest component probe all of the group. Both sides are dealt into blocks of about BLOCK shingles, and
    each cell of the grid counts shared shingles by an inverted index of its members, so that no pair is ever a row.
    """
    parts = groups.groupBy("group", "component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    of = parts.groupBy("group").agg(F.sum("n").alias("n"), F.max(F.struct("docs", (-F.col("component")).alias("c"), "n")).alias("top"), F.count(F.lit(1)).alias("components")).where("components > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.least(F.lit(SPREAD), F.ceil(n * 16 / BLOCK))).cast("int")
    of = of.select("group", (-F.col("top.c")).alias("main"), blocks(F.col("n")).alias("mb"), blocks(F.col("n") - F.col("top.n")).alias("pb"))
    deal = lambda n: F.pmod(F.hash("doc_id"), F.col(n))
    at = lambda role, i, j: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    probing = F.when(F.col("component") != F.col("main"), each("mb", lambda i: at(1, i, deal("pb")))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))
    placed = groups.join(of, "group").select("group", "doc_id", "component", F.explode(F.concat(each("pb", lambda j: at(0, deal("mb"), j)), probing)).alias("at"))
    keys = ("level", "id", "i", "j")
    cells = placed.join(sets.select("doc_id", "shingles"), "doc_id").select("group.level", "group.id", "at.i", "at.j", "at.role", "doc_id", "component", "shingles")
    cells = cells.repartition(*keys).sortWithinPartitions(*keys, "role")

    def cell(members: list, probing: list) -> Iterator[pa.RecordBatch]:
        if not members or not probing:  # blocks are dealt by hash: few texts leave some without any
            return
        sets = [np.frombuffer(m[2], U) for m in members]
        size, component = np.array([len(x) for x in sets]), np.array([m[1] for m in members])
        h, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        found = []
        for doc, own, shingles in probing:
            x = np.frombuffer(shingles, U)
            lo, hi = np.searchsorted(h, x, "left"), np.searchsorted(h, x, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(who[at], minlength=len(sets))
            hit = np.flatnonzero((100 * both >= percent * (size + len(x) - both)) & (component != own))
            found += [(doc, members[hit[k]][0]) for k in np.unique(component[hit], return_index=True)[1]]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])
        for batch in batches:
            for *own, role, doc, component, shingles in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if own != at:
                    yield from cell(*sides)
                    at, sides = own, ([], [])
                row = doc, component, shingles
                sides[role].append(row)
        yield from cell(*sides)

    return cells.mapInArrow(probe, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, k: int = K, m: int = M) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept (doc_id is its component's smallest).

    A-Z are lower-cased; words are runs of characters other than space and tab to carriage return; the set of a text
    is its distinct shingles of `shingle` words, or its whole word sequence if it has fewer. Documents link if their
    sets' Jaccard similarity is at least percent / 100.

    Null or wordless text has an empty set and is linked with nothing. Rows without id are linked with nothing and
    kept, component null. Rows that repeat an id are one document. No rows give no rows. Other columns play no part.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tasks, short, buckets = tasks_for(docs), tasks_for(docs, True), bucket_count(docs)
    signed = materialise(signatures(docs, shingle, k, m), "signed", tasks)
    classes = signed.where("doc_id is not null and set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    reps = materialise(classes, "classes", tasks)
    stars = materialise(_stars(reps, m, buckets), "stars", short)
    nodes = materialise(stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct().join(reps.select("doc_id", "set_hash"), "doc_id"), "nodes", short)
    sets = materialise(_sets(nodes, docs.where("doc_id is not null"), shingle), "sets", tasks)
    links = materialise(_verified(stars, sets, percent), "verified", tasks)
    found = materialise(connected_components(links, short), "components", short)
    component = F.coalesce("component", "doc_id").alias("component")
    # all documents of a key are in one cluster of stars; only clusters of several components can have open keys
    clusters = connected_components(stars, short).withColumnsRenamed({"node": "doc_id", "component": "cluster"})
    grouped = materialise(clusters.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", component, "cluster"), "grouped", short)
    open_ = grouped.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.min("component").alias("low"), F.max("component").alias("high")).where("docs > 2 and low <> high").select("cluster")
    open_ = materialise(open_, "clusters", short)
    if not open_.isEmpty():
        members = grouped.join(open_, "cluster").join(reps.select("doc_id", "signature"), "doc_id").join(sets.select("doc_id", "n"), "doc_id")
        groups = _groups(materialise(members, "members", tasks), m, tasks, short)
        more = materialise(_across(groups, sets, percent), "more", tasks)
        if not more.isEmpty():
            found = materialise(connected_components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), short), "components", short)
    of_class = reps.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_hash", component)
    out = signed.join(of_class, "set_hash", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that near_duplicates() keeps, as they are: one document of each group of near copies.

    Rows that repeat an id are kept or dropped together; rows without id stay. Columns may have any names.
    """
    (name,) = fresh(df.columns, "gone")
    gone = materialise(near_duplicates(df, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone", tasks_for(df, True))
    return df.join(F.broadcast(gone) if few(gone) else gone, F.col(id_col) == F.col(name), "left_anti").coalesce(tasks_for(df))
