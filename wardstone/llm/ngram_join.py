"""N-gram Jaccard join by chosen paths, with exact checks.

Texts are sets of five-word shingles. Equal sets become one (the smallest doc_id stands for them). A set is embedded as 128 min-hash
tokens. In each run a set starts at the root path and, level by level, follows every child whose token it has and whose hash of
(path, token) falls under 1 / (threshold * 128): the same choices for all sets, so two sets meet in a bucket if a path of shared tokens is
chosen. A pair at the threshold keeps one shared path on average, whatever the depth; runs are repeated until the chance that it survives
in one of them reaches the target recall. Buckets of up to ``small`` sets are compared by brute force on the tokens. A larger bucket whose sets all
look like one of 8 hubs that hang together, by 64 one-bit tokens, is a crowd of near copies: all are linked to their hubs, so every pair is in one component.
The other large buckets are split two levels further, twice, by all chosen children too; the runs are those that the deepest level needs, so the target
holds in crowds as well. Sets that still share a large bucket then agree on 8 sampled tokens and are all linked to its smallest.

Links found so far only say which sets may be alike. Their connected components are then compared exactly, every pair of a component
whose sizes allow the threshold, in tiles of bounded size, each pair in exactly one tile. Tiles give each set's number of links and a
spanning forest of its verified links, never the pairs. So a component that holds a third of all rows is many tasks, and no link between
two texts of a component is lost.

Defined cases: a text of one to four words is one shingle; a null, empty or wordless text has no shingles, no links and is its own class. Rows with a null
doc_id have a null class and no links. Repeated rows count as documents of their own. Extra columns are ignored by ``similar_documents`` and kept by
``one_of_each``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, partitions, released, slices, small_batches, written
from .components import components
from .kernel import mix, shingle_sets

TOKENS = 128
FAR = 23  # of 64 bits: sets of similarity 0.67 differ in 11 on average, in more than 23 once in some ten thousand; of 64 sets of similarity 0.4, some do
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 2**31, TOKENS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, TOKENS, dtype=np.uint32)


def embed(own: np.ndarray) -> np.ndarray:
    """128 min-hashes of 16 bits of a set of 64-bit hashes."""
    low = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(own), 2048):
            h = (own[i : i + 2048] >> np.uint64(32)).astype(np.uint32)
            np.minimum(low, (h[:, None] * _MUL + _ADD).min(axis=0), out=low)
        return (mix(low.astype(np.uint64), 3) & np.uint64(0xFFFF)).astype(np.uint16)


def sketch(tokens: np.ndarray) -> int:
    """One bit of each of the first 64 tokens: two sets of similarity j differ in about (1 - j) / 2 of them."""
    return int(np.packbits((tokens[:64] & 1).astype(np.uint8)).view(np.int64)[0])


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles), key (hash of the set), tokens (its embedding), bits (a sketch of it), for rows with shingles and a doc_id."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                sets = shingle_sets(b.column("text"), words)
                at = [i for i, s in enumerate(sets) if len(s)]
                if at:
                    tokens = [embed(sets[i]) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(at)), pa.array([len(sets[i]) for i in at], pa.int64()), pa.array([hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in at]), pa.array([t.tobytes() for t in tokens]), pa.array([sketch(t) for t in tokens], pa.int64())],
                        ["doc_id", "n", "key", "tokens", "bits"],
                    )

    small_batches(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(run), "doc_id long, n long, key binary, tokens binary, bits long")


def _tokens(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


def follow(tokens: np.ndarray, owner: np.ndarray, path: np.ndarray, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths that are levels longer: (owner, path). owner indexes the rows of tokens."""
    limit = np.uint64(int(2**64 / (threshold * TOKENS)))
    ids = tokens.astype(np.uint64) | (np.arange(TOKENS, dtype=np.uint64) << np.uint64(16))
    salt = mix(ids, 21)
    for _ in range(levels):
        owners, paths = [], []
        for i in range(0, len(owner), 4096):
            h = mix(salt[owner[i : i + 4096]] ^ path[i : i + 4096, None], 29)
            row, col = np.nonzero(h < limit)
            owners.append(owner[i : i + 4096][row])
            paths.append(mix(h[row, col], 31))
        owner = np.concatenate(owners) if owners else owner[:0]
        path = np.concatenate(paths) if paths else path[:0]
    return owner, path


def least_share(threshold: float) -> float:
    """The share of tokens that a pair must agree on to be linked: three standard deviations under the threshold."""
    return threshold - 3 * math.sqrt(threshold * (1 - threshold) / TOKENS)


def runs_for(recall: float, depth: int, threshold: float = 0.8) -> int:
    """Runs after which a pair at the threshold has shared a bucket, depth levels deep, and passed the check of tokens with this chance: a branching process for each number of tokens that the pair may agree on."""
    p = 1 / (threshold * TOKENS)
    agreed = [(k, math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k)) for k in range(TOKENS + 1) if k >= least_share(threshold) * TOKENS]
    missed = []
    for k, share in agreed:
        alive = 1.0
        for _ in range(depth):
            alive = 1 - (1 - p * alive) ** k
        missed.append((share, 1 - alive))
    most = sum(share for _, share in agreed)
    recall = min(recall, most - (1 - most))  # some pairs fail the check of tokens whatever the runs
    runs = 1
    while sum(share * (1 - miss**runs) for share, miss in missed) < recall:
        runs += 1
    return runs


def bucket_rows(sets: DataFrame, runs: int, depth: int, threshold: float) -> DataFrame:
    """(path, id) of all runs, each once: a set's paths differ by their run or by a token."""

    def run(batches):
        roots = mix(np.arange(runs, dtype=np.uint64), 41)
        for b in batches:
            tokens, ids = _tokens(b.column("tokens")), np.asarray(b.column("id"))
            owner, path = follow(tokens, np.repeat(np.arange(len(ids)), runs), np.tile(roots, len(ids)), depth, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[owner])], ["path", "id"])

    return sets.select("id", "tokens").mapInArrow(released(run), "path long, id long")


def split_rows(rows: DataFrame, sets: DataFrame, levels: int, threshold: float) -> DataFrame:
    """(path, id) with each path followed further, by all chosen children: a pair at the threshold keeps as many shared paths as it had, on average."""

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column("id"))
            owner, path = follow(_tokens(b.column("tokens")), np.arange(len(ids)), np.asarray(b.column("path")).view(np.uint64), levels, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[owner])], ["path", "id"])

    return rows.join(sets.select("id", "tokens"), "id").select("path", "id", "tokens").mapInArrow(released(run), "path long, id long")


def _grouped(batches, key: str):
    """Record batches of whole groups from rows sorted by key: consecutive equal keys together, many groups to a batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(key))
        last = int(np.searchsorted(k, k[-1])) if k[0] != k[-1] else 0
        if last == 0 and held and np.asarray(held[-1].column(key))[-1] == k[0]:
            held.append(b)
            continue
        if last == 0 and not held:
            held.append(b)
            continue
        yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a-b of n nodes."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def bucket_links(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): a spanning forest, for each group of ids, of the pairs that agree on at least this share of tokens."""

    def run(batches):
        for t in _grouped(batches, "gid"):
            gid, ids, tokens = t.column("gid").to_numpy(), t.column("id").to_numpy(), _tokens(t.column("tokens"))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(gid)) + 1, [len(gid)]])
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            like = (tokens[two] == tokens[two + 1]).mean(axis=1) >= least if len(two) else np.zeros(0, bool)
            a, b = [ids[two[like]]], [ids[two[like] + 1]]
            for s, m in zip(cut[:-1][size > 2], size[size > 2]):
                own = tokens[s : s + m]
                same = np.stack([(own[i] == own).mean(axis=1) for i in range(m)]) >= least
                for x, y in _forest(m, *np.nonzero(np.triu(same, 1))):
                    a.append(ids[s + x : s + x + 1])
                    b.append(ids[s + y : s + y + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rows = groups.select(F.xxhash64("ids").alias("gid"), F.explode("ids").alias("id")).join(sets.select("id", "tokens"), "id")
    n = partitions(groups.sparkSession)
    return rows.select("gid", "id", "tokens").repartition(n, "gid").sortWithinPartitions("gid", "id").mapInArrow(released(run), "a long, b long")


def crowds(large: DataFrame, hubs: int = 8) -> DataFrame:
    """path, id, hub, crowd of large buckets (path, id, bits): the first of a bucket's hubs that a set looks like; crowd: every set looks like one and the hubs hang together, so that all the bucket's sets are linked through hubs."""
    salted = [F.xxhash64("id", F.lit(k)) for k in range(hubs)]
    picked = large.groupBy("path").agg(*[f(c, h).alias(f"{c}{k}") for k, h in enumerate(salted) for f, c in ((F.min_by, "id"), (F.min_by, "bits"))])
    picked = picked.select("path", F.array(*[F.struct(F.col(f"id{k}").alias("id"), F.col(f"bits{k}").alias("bits")) for k in range(hubs)]).alias("hubs"))
    seen = large.join(picked, "path").withColumn("at", F.array_position(F.transform("hubs", lambda h: F.bit_count(h["bits"].bitwiseXOR(F.col("bits"))) <= FAR), True))
    seen = seen.select("path", "id", F.when(F.col("at") > 0, F.element_at("hubs", F.greatest(F.col("at"), F.lit(1)).cast("int"))["id"]).alias("hub"), (F.col("at") == 1).alias("main"))
    # a hub but the main one that looks like none before it stands apart
    whole = seen.groupBy("path").agg(F.min(F.col("hub").isNotNull() & (F.col("main") | (F.col("hub") != F.col("id")))).alias("crowd"))
    return seen.drop("main").join(whole, "path")


def candidate_links(sets: DataFrame, threshold: float, recall: float, small: int, scratch: list[DataFrame]) -> DataFrame:
    """(a, b): links that join every pair found alike, by the chosen paths."""
    depth, splits = 4, (2, 2, 0)
    rows = written(bucket_rows(sets, runs_for(recall, depth + sum(splits), threshold), depth, threshold), "paths", scratch)
    groups, crowded = None, None
    for deeper in splits:
        sizes = written(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub")).where("size > 1"), "path-sizes", scratch)
        own = rows.join(sizes.where(F.col("size") <= small).select("path"), "path").groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids")
        groups = own if groups is None else groups.union(own)
        large = rows.join(sizes.where(F.col("size") > small).select("path", "hub"), "path")
        if deeper:
            seen = written(crowds(written(large.select("path", "id").join(sets.select("id", "bits"), "id"), "large-buckets", scratch)), "crowds", scratch)
            rows = written(split_rows(seen.where("not crowd").select("path", "id"), sets, deeper, threshold), "paths", scratch)
            large = seen.where("crowd")
        linked = large.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
        crowded = linked if crowded is None else crowded.union(linked)
    return bucket_links(groups.distinct(), sets, least_share(threshold)).union(crowded.distinct())


def exact(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction, so that comparisons are between integers: 0.55 is 11 / 20."""
    f = Fraction(str(threshold)).limit_denominator(1 << 20)
    return f.numerator, f.denominator


def tile_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of a left and a right set, i before j, with Jaccard similarity of at least the threshold."""
    num, den = exact(threshold)
    n = np.array([len(s) for s in sets], np.int64)
    allowed = den * np.minimum(n[:, None], n) >= num * np.maximum(n[:, None], n)
    allowed &= left[:, None] & right[None, :] | right[:, None] & left[None, :]
    allowed = np.triu(allowed, 1)
    i, j = np.nonzero(allowed)
    if not len(i):
        return i, j
    if len(sets) <= 12:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
        ok = den * both >= num * (n[i] + n[j] - both)
        return i[ok], j[ok]
    owner = np.repeat(np.arange(len(sets)), n)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(col)
    kept = often[col] > 1
    owner, col = owner[kept], (np.cumsum(often > 1) - 1)[col[kept]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width, total = max(256, (4 << 20) // len(sets)), int(col[-1]) + 1 if len(col) else 0
    for at in range(0, total, width):
        a, z = np.searchsorted(col, [at, at + width])
        m = np.zeros((len(sets), min(width, total - at)), np.float32)
        m[owner[a:z], col[a:z] - at] = 1
        both += m @ m.T
    shared = both[i, j].astype(np.int64)
    ok = den * shared >= num * (n[i] + n[j] - shared)
    return i[ok], j[ok]


def verified(docs: DataFrame, members: DataFrame, make_sets, threshold: float, tile: int) -> DataFrame:
    """(a, b, links) of the exact comparison within components. members: id, root, copies, n; make_sets turns an Arrow array of texts into their sets. Rows with b: a spanning link; rows without: links of set a in one tile, as a number of documents."""
    spark = docs.sparkSession
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    # a tile holds two blocks: at most about 2 * tile sets and 16 MB of hashes each, but for a single larger set
    blocks = F.greatest(F.ceil(F.col("size") / tile), F.ceil(F.col("total") * 8 / (16 << 20))).cast("int")
    own = members.join(sizes.select("root", blocks.alias("blocks")).hint("shuffle_merge"), "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("id").isNotNull())
    both = texts.join(own.hint("shuffle_merge"), "id")

    def sets(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                got = pa.array([s.tobytes() for s in make_sets(b.column("text"))], pa.binary())
                yield b.drop_columns(["text"]).append_column("set", got)

    rows = both.select("id", "root", "copies", "blocks", "block", "text").mapInArrow(released(sets), "id long, root long, copies long, blocks int, block int, set binary")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    rows = rows.withColumn("t", F.explode(tiles)).select("id", "root", "copies", "block", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.xxhash64("root", "t.i", "t.j").alias("gid"), "set")

    def run(batches):
        for t in _grouped(batches, "gid"):
            gid = t.column("gid").to_numpy()
            ids, root, copies, block, low, high = (t.column(c).to_numpy() for c in ("id", "root", "copies", "block", "i", "j"))
            held = t.column("set").to_pylist()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(gid)) + 1, [len(gid)]])
            a, b, links = [], [], []
            for s, e in zip(cut[:-1], cut[1:]):
                _, first = np.unique(np.stack([root[s:e], low[s:e], high[s:e], ids[s:e]]), axis=1, return_index=True)  # repeated rows of a document
                first = first + s
                for k in _same_tile(root[first], low[first], high[first]):
                    at = first[k]
                    if len(at) < 2:
                        continue
                    x, y = tile_links([np.frombuffer(held[q], np.uint64) for q in at], block[at] == low[at], block[at] == high[at], threshold)
                    if not len(x):
                        continue
                    n = np.bincount(x, copies[at[y]], len(at)) + np.bincount(y, copies[at[x]], len(at))
                    some = np.flatnonzero(n)
                    a += [ids[at[some]].tolist()]
                    b += [[None] * len(some)]
                    links += [n[some].astype(np.int64).tolist()]
                    for p, q in _forest(len(at), x, y):
                        a.append([int(ids[at[p]])])
                        b.append([int(ids[at[q]])])
                        links.append([None])
            if a:
                yield pa.RecordBatch.from_arrays([*[pa.array(itertools.chain.from_iterable(x), pa.int64()) for x in (a, b, links)]], ["a", "b", "links"])

    return rows.repartition(partitions(spark), "gid").sortWithinPartitions("gid", "id").mapInArrow(released(run), "a long, b long, links long")


def _same_tile(*keys: np.ndarray):
    """Indexes of rows that agree on all keys (different tiles may share a hash); keys are sorted together."""
    if not len(keys[0]):
        return []
    change = np.any([np.diff(k) != 0 for k in keys], axis=0)
    return np.split(np.arange(len(keys[0])), np.flatnonzero(change) + 1)


def similar_documents(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.99, small: int = 64, tile: int = 512) -> DataFrame:
    """doc_id, class_id (smallest doc_id of those linked, directly or not), n_links (other documents with similarity of at least the threshold), n_copies (of them with the same set)."""
    rows = written(set_rows(docs, words), "shingle-sets")
    scratch: list[DataFrame] = []
    sets = written(rows.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("tokens").alias("tokens"), F.min("bits").alias("bits")), "distinct-sets", scratch)
    roots = components(candidate_links(sets, threshold, recall, small, scratch), scratch=scratch)
    classes = _classes(docs, sets, roots, lambda texts: shingle_sets(texts, words), threshold, tile, scratch)
    return rows.select("doc_id", "key").join(classes.hint("shuffle_merge"), "key").drop("key")


def _classes(docs: DataFrame, sets: DataFrame, roots: DataFrame, make_sets, threshold: float, tile: int, scratch: list[DataFrame]) -> DataFrame:
    """key, class_id, n_links, n_copies of each distinct set, from the candidates' components. Drops the tables in scratch."""
    members = written(roots.withColumnRenamed("node", "id").join(sets.select("id", "copies", "n"), "id"), "members", scratch)
    found = written(verified(docs, members, make_sets, threshold, tile), "verified", scratch)
    classes = components(found.where("b is not null").select("a", "b"), scratch=scratch)
    links = found.where("links is not null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    of_set = sets.select("key", "id", "copies").join(links, "id", "left").join(classes.withColumnRenamed("node", "id"), "id", "left")
    out = written(of_set.select("key", F.coalesce("root", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (F.col("copies") - 1).alias("n_copies")), "set-classes")
    for t in scratch:
        drop_written(t)
    return out


def all_documents(docs: DataFrame, **options) -> DataFrame:
    """similar_documents with the rows that have no shingles or no doc_id: their own class, no links."""
    linked = similar_documents(docs, **options)
    # Rows with shingles are in linked as often as in docs; the rest is told apart by their texts alone.
    rest = docs.where(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z\u0080-\x{10FFFF}]")).select(F.col("doc_id").cast("long").alias("doc_id"))
    zero = F.lit(0).cast("long")
    return linked.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is its class's smallest; rows without doc_id stay. Rows repeated whole stay once; a doc_id that stands on different texts goes with any of them."""
    found = written(all_documents(docs, **options).where(F.col("doc_id").isNotNull()), "classes")
    gone = found.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates()).select(*docs.columns)
