"""Document fingerprints by spot signatures.

A spot is a very common word (an anchor) with the chain of the next content words after it, anchors skipped. A text's
signatures are the set of its spots, and those of its runs of chain + 1 words whose hash is a multiple of 8, so that lists, tables and capitals have some too. A text with
no signature then has one, that of all its words, or of its bytes where it has no words, so equal texts always have equal sets.

The fingerprint string is ``<number of signatures>:<hash of the whole set>:<the 128 smallest hashes>``; two are equal exactly if the sets are. The likeness of two
fingerprints is that of the 128 smallest hashes of both together: the share of them that both have. It is the Jaccard similarity of sets of up to 128 signatures together, and
within 0.05 of it (one standard deviation) beyond.

``near_duplicates`` finds all documents whose sets reach a threshold: sets are partitioned by their size so that a set can only match within its own or the
next partition, meet there by the signatures of their prefixes (so many of the smallest that two sets above the threshold share one), and are compared
with Jaccard similarities pruned by size, in tiles of connected candidates. No pair above the threshold is lost.

Defined cases: a null text is the empty text. Repeated rows get equal fingerprints. Null doc_ids sort first, by a hash of their texts. Extra columns are ignored. In the
circle of next documents equal doc_ids are ordered by their texts, and a lone row is its own next document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, slices, small_batches, written
from .components import components
from .kernel import _POW, Words, mix, row_sets, shingles, word_hash, words
from .ngram_join import _classes

#: Frequent function words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their them then there they this to was we were what which who will with you
aber als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer eines er es für haben hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so um und uns von war was wie wird zu zum zur über
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais me ne nous on ou par pas pour qui que sa se ses son sur un une vous été être
al como con de del el ella ellos en entre es esta este fue ha la las lo los más me no o para pero por que se si sin sobre su sus también un una y ya
""".split()


def anchor_hashes(anchors: list[str]) -> np.ndarray:
    return np.unique(np.array([word_hash(a) for a in anchors], np.uint64))


def signatures(w: Words, anchors: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each spot: an anchor and the next chain content words of the same text."""
    at = np.searchsorted(anchors, w.h)
    at[at == len(anchors)] = 0
    common = anchors[at] == w.h if len(anchors) else np.zeros(len(w.h), bool)
    content = np.flatnonzero(~common)
    spots = np.flatnonzero(common)
    first = np.searchsorted(content, spots)
    ok = first + chain <= len(content)
    spots, first = spots[ok], first[ok]
    ok = w.doc[content[first + chain - 1]] == w.doc[spots] if len(spots) else np.zeros(0, bool)
    spots, first = spots[ok], first[ok]
    with np.errstate(over="ignore"):
        h = w.h[spots] * _POW[1]
        for i in range(chain):
            h = h + w.h[content[first + i]] * _POW[i + 2]
    return w.doc[spots], mix(h, 11)


def signature_sets(arr: pa.Array, anchors: np.ndarray, chain: int = 2) -> list[np.ndarray]:
    w = words(arr)
    rows = len(w.offsets) - 1
    doc, h = signatures(w, anchors, chain)
    out = row_sets(doc, h, rows)
    b = w.bounds()
    d, g = shingles(w, chain + 1)
    thin = g & np.uint64(7) == 0
    d, g = d[thin], g[thin]
    at = np.searchsorted(d, np.arange(rows + 1))
    for i in np.flatnonzero(np.diff(at)):
        out[i] = np.union1d(out[i], g[at[i] : at[i + 1]])
    for i in range(rows):
        if not len(out[i]):
            if b[i + 1] > b[i]:
                with np.errstate(over="ignore"):
                    own = w.h[b[i] : b[i + 1]]
                    total = (mix(own + np.arange(len(own), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 13)).sum()
                out[i] = mix(np.array([total], np.uint64), 17)
            else:
                raw = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                out[i] = np.frombuffer(hashlib.sha256(raw).digest()[:8], "<u8").astype(np.uint64)
    return out


def fingerprint(own: np.ndarray, smallest: int = 128) -> str:
    """own: a sorted set of hashes."""
    whole = hashlib.sha256(own.astype("<u8").tobytes()).hexdigest()[:24]
    return f"{len(own)}:{whole}:{(own[:smallest] >> np.uint64(32)).astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str, smallest: int = 128) -> float:
    """Of two fingerprints: of their smallest hashes together, the share that both have."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(":", 1)[1]), ">u4") for f in (a, b))
    both = np.sort(np.concatenate([x, y]))
    twice = np.append(both[1:] == both[:-1], False)
    whole = np.append(True, both[1:] != both[:-1])
    seen = np.cumsum(whole)
    return float(np.count_nonzero(twice & (seen <= smallest)) / min(smallest, int(seen[-1])))


def in_id_order(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs in ranges of doc_id, one per partition, sorted, each followed by the first row of the next range (guest); the first row of all follows the last range.

    Columns: bucket, guest, doc_id and columns. Texts are shuffled once. Cut points come from quantiles of all ids, as many as a few
    per partition; a row that starts a range is sent to the range before it as well.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    cuts = 4 * n
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    row = ids.agg(F.percentile_approx("id", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("q"), F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("none")).first()
    edges = sorted(set(row.q or []) - {row.first}) if not row.none else sorted(set(row.q or []) | ({row.first} - {None}))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    if not edges:
        both = base.withColumn("bucket", F.lit(0))
        starts = F.lit(True)
        last = 0
    else:
        step = max(1, int(len(edges) ** 0.5))
        tiers = F.array(*[F.array(*[F.lit(x) for x in edges[i : i + step]]) for i in range(0, len(edges), step)])
        passed = F.size(F.filter(tiers, lambda t: t[0] <= F.col("doc_id")))
        inner = F.when(passed > 0, (passed - 1) * step + F.size(F.filter(F.element_at(tiers, F.greatest(passed, F.lit(1))), lambda x: x <= F.col("doc_id")))).otherwise(0)
        both = base.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(inner).cast("int"))
        starts = F.col("doc_id") == row.first
        if row.none:  # of the rows without an id, the first by hash
            least = base.where("doc_id IS NULL").agg(F.min(F.xxhash64(*columns)).alias("h")).first().h
            starts = F.col("doc_id").isNull() & (F.xxhash64(*columns) == least)
        edge = F.element_at(F.array(*[F.lit(x) for x in edges]), F.greatest(F.col("bucket"), F.lit(1)))
        starts = F.coalesce(starts, F.lit(False)) | F.coalesce((F.col("bucket") > 0) & (edge == F.col("doc_id")), F.lit(False))
        last = len(edges)
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    held = F.when(starts, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")), F.struct(before.cast("int").alias("bucket"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))))
    both = both.withColumn("held", F.explode(held)).select(F.col("held.bucket").alias("bucket"), F.col("held.guest").alias("guest"), "doc_id", *columns)
    return both.repartitionByRange(n, "bucket").sortWithinPartitions(F.col("bucket"), F.col("guest"), F.col("doc_id").asc_nulls_first(), F.when(F.col("doc_id").isNull(), F.xxhash64(*columns)), *columns)


def edited_fingerprints(docs: DataFrame, anchors: list[str] | None = None, chain: int = 2) -> DataFrame:
    """Each document, its edited text (the last quarter replaced by the start of the next document) and the next document compared.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    held = anchor_hashes(ANCHORS if anchors is None else anchors)
    small_batches(docs.sparkSession)

    def run(batches):
        kept: tuple | None = None  # the row whose next one is not yet seen
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                texts = b.column("text")
                sets = list(map(fingerprint, signature_sets(texts, held, chain)))
                own = list(zip(b.column("bucket").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), texts.to_pylist(), sets))
                jobs = []
                for row in own:
                    if kept is not None and kept[0] == row[0]:
                        jobs.append((kept, row))
                    kept = row if row[1] == 0 else None
                if jobs:
                    yield pairs(jobs)

    def pairs(jobs):
        edited = []
        for (_, _, _, text, _), (_, _, _, after, _) in jobs:
            q = len(text) // 4
            edited.append(text[: len(text) - q] + after[:q])
        sets = list(map(fingerprint, signature_sets(pa.array(edited, pa.string()), held, chain)))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([a[2] for a, _ in jobs], pa.int64()), "n_chars": pa.array([len(a[3]) for a, _ in jobs], pa.int64()), "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": [a[4] for a, _ in jobs], "edited_fingerprint": sets, "near_edited": [likeness(a[4], s) for (a, _), s in zip(jobs, sets)], "near_next": [likeness(a[4], b[4]) for a, b in jobs],
            }
        )

    rows = in_id_order(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), ["text"])
    return rows.mapInArrow(released(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, anchors: list[str] | None = None, chain: int = 2, tile: int = 512) -> DataFrame:
    """doc_id, class_id (smallest doc_id of those linked, directly or not), n_links (other documents whose sets reach the threshold), n_copies (of them with the same set). Rows without a doc_id are left out."""
    held = anchor_hashes(ANCHORS if anchors is None else anchors)
    small_batches(docs.sparkSession)
    make = lambda texts: signature_sets(texts, held, chain)

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                sets = make(b.column("text"))
                prefix = [s[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([p.tolist() for p in prefix], pa.list_(pa.int64()))],
                    ["doc_id", "n", "key", "prefix"],
                )

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = written(texts.mapInArrow(released(run), "doc_id long, n long, key binary, prefix array<long>"), "spot-sets")
    scratch: list[DataFrame] = []
    sets = written(rows.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("prefix").alias("prefix")), "distinct-spots", scratch)
    # sizes of a partition differ by less than the threshold allows, so matches lie in the same or the next one: a set shows up in both
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9)
    shown = sets.select("id", F.explode("prefix").alias("spot"), size.alias("size")).withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    meet = written(shown.groupBy("spot", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("spot", "size", "first"), "spot-meetings", scratch)
    links = shown.join(meet.hint("shuffle_merge"), ["spot", "size"]).where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    classes = _classes(texts, sets, components(links, scratch=scratch), make, threshold, tile, scratch)
    return rows.select("doc_id", "key").join(classes.hint("shuffle_merge"), "key").drop("key")
