"""Inserts and deletes over a published index: delta segments, tombstones, and searches that see both."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions.hashing import digest_bits, hashed_list, is_deleted
from vexel.operators import kmeans
from vexel.operators.brute import brute_force_knn
from vexel.operators.evaluation import recall, throughput
from vexel.operators.ivf import IVFIndex, scan, without
from vexel.operators.pq import RERANK, Codebook, adc, encode, rerank
from vexel.operators.topk import distinct_topk

#: The value of every element of a vector that is far from all others.
FAR = 1000.0


def delta_vectors(base: DataFrame, queries: DataFrame, n: int, mode: str, n_base: int, dim: int, seed: int = 0, protected: DataFrame | None = None) -> DataFrame:
    """local_id, vec, source_id: fixtures of inserted rows. Modes: far; query-copy; main-sample and random-main-sample
    (the first n rows of the base, by id or by a seeded hash; each row once); random-u8."""
    spark = base.sparkSession
    ids = spark.range(n).select(F.col("id").alias("local_id"))
    far = F.array_repeat(F.lit(FAR).cast("float"), dim)
    none = F.lit(None).cast("long")
    if mode == "far":
        return ids.select("local_id", far.alias("vec"), none.alias("source_id"))
    if mode == "query-copy":
        q = queries.select(F.col("qid").alias("local_id"), F.col("q").cast("array<float>").alias("q"))
        return ids.join(q, "local_id", "left").select("local_id", F.coalesce("q", far).alias("vec"), none.alias("source_id"))
    if mode == "random-u8":
        value = lambda i: digest_bits(2, F.col("local_id"), F.lit(seed), i).cast("float")
        return ids.select("local_id", F.transform(F.sequence(F.lit(1), F.lit(dim)), value).alias("vec"), none.alias("source_id"))
    if mode not in ("main-sample", "random-main-sample"):
        raise ValueError(f"mode {mode!r}")
    if protected is not None:
        base = base.join(protected.select("id"), "id", "left_anti")
    order = F.struct(F.col("id"))
    if mode == "random-main-sample":  # row number `seed` opens the sample; the others follow by a keyed hash of their ids
        order = F.struct(F.col("id") != seed % max(1, n_base), digest_bits(15, F.col("id"), F.lit(seed)), F.col("id"))
    first = base.withColumn("_o", order).orderBy("_o").limit(n)
    ranked = _numbered(first)
    return ids.join(ranked, "local_id", "left").select("local_id", F.coalesce(F.col("vec").cast("array<float>"), far).alias("vec"), "source_id")


def _numbered(first: DataFrame) -> DataFrame:
    """The n rows of a fixture, numbered in their order."""
    return first.select((F.row_number().over(Window.orderBy("_o")) - 1).cast("long").alias("local_id"), F.col("id").alias("source_id"), "vec")


def delta_segment(new: DataFrame, index: IVFIndex, n_base: int, lists: str = "nearest", seq: Column | None = None) -> DataFrame:
    """id (n_base + local_id), cid, vec, seq. lists: "nearest" centroid; "hash", a Fibonacci hash of the local id; or
    "source", the list of the row that source_id names, and the hash where there is none."""
    if lists == "source":
        own = index.lists.select(F.col("id").alias("source_id"), "cid").join(new.select("source_id").distinct(), "source_id", "left_semi")
        rows = new.withColumn("_seq", seq if seq is not None else F.col("local_id")).join(own, "source_id", "left")
        cid = F.coalesce("cid", hashed_list(F.col("local_id"), index.nlist))
        return rows.select((F.col("local_id") + n_base).alias("id"), cid.alias("cid"), "vec", F.col("_seq").alias("seq"))
    rows = new.select((F.col("local_id") + n_base).alias("id"), "vec", (seq if seq is not None else F.col("local_id")).alias("seq"), "local_id")
    if lists == "hash":
        return rows.withColumn("cid", hashed_list(F.col("local_id"), index.nlist)).select("id", "cid", "vec", "seq")
    if lists != "nearest":
        raise ValueError(f"lists {lists!r}: nearest, hash or source")
    return kmeans.assign_nearest(rows, index.centroids).select("id", "cid", "vec", "seq")


def tombstones(base: DataFrame, ratio: float, protected: DataFrame | None = None) -> DataFrame:
    """The ids that a ratio deletes by hash, but for protected ones."""
    gone = base.filter(is_deleted(F.col("id"), ratio)).select("id")
    return gone if protected is None else gone.join(protected.select("id"), "id", "left_anti")


def published_deletes(ratio: float, n_base: int) -> Column | None:
    """tombstones() as a rule: published rows, not inserted ones, whose hash falls under the ratio."""
    return is_deleted(F.col("id"), ratio) & (F.col("id") < n_base) if ratio else None


def search_delta(delta: DataFrame, queries: DataFrame, k: int, index: IVFIndex, probes: DataFrame | None = None, mode: str = "flat") -> DataFrame:
    """mode flat: all inserted rows; ivf: those in the lists that the queries probe."""
    if mode == "flat":
        return brute_force_knn(delta, queries, k, index.metric)
    if mode != "ivf" or probes is None:
        raise ValueError(f"mode {mode!r}: flat, or ivf with probes")
    return scan(delta, probes, queries, k, index.metric)


def overlay_search(index: IVFIndex, queries: DataFrame, k: int, nprobe: int, delta: DataFrame | None = None, deleted: DataFrame | Column | None = None, mode: str = "flat") -> DataFrame:
    """The published index without its deleted rows, and the inserted ones, as one answer. Deleted rows are left out
    before ranking, so no overfetch is needed and a result is short only if there are fewer rows than k."""
    found = index.search(queries, k, nprobe, deleted=deleted).select("qid", "id", "dist")
    if delta is not None:
        live = without(delta, deleted)
        probes = index.route(queries, nprobe) if mode == "ivf" else None
        found = found.unionByName(search_delta(live, queries, k, index, probes, mode).select("qid", "id", "dist"))
    return distinct_topk(found, k).select("qid", "rank", "id", "dist")


def pq_overlay_search(codes: DataFrame, index: IVFIndex, book: Codebook, queries: DataFrame, k: int, nprobe: int, delta: DataFrame, deleted: DataFrame | Column | None = None, rerank_n: int = RERANK) -> DataFrame:
    """The overlay over codes: candidates of the published codes and of the inserted rows', encoded alike, then one
    exact rerank. Deleted rows are left out before the candidates are chosen. Codes and candidates are computed once."""
    segment = IVFIndex(index.centroids, delta.select("id", "cid", "vec"), index.metric)
    new, probes = without(encode(segment, book), deleted), index.route(queries, nprobe)
    codes, new = without(codes, deleted).persist(), new.persist()
    try:
        n = max(rerank_n, k)
        found = adc(codes, index, book, queries, probes, n).unionByName(adc(new, index, book, queries, probes, n))
        return rerank(found, index.lists.select("id", "vec").unionByName(delta.select("id", "vec")), queries, k, index.metric)
    finally:
        codes.unpersist()
        new.unpersist()


@dataclass(frozen=True)
class Event:
    """query: rows qb to qb + qn - 1 of the query set; insert: the delta grows to insert_to rows; delete: the ratio
    grows to delete_to."""

    seq: int
    kind: str
    qb: int = 0
    qn: int = 0
    insert_to: int = 0
    delete_to: float = 0.0


def mixed_events(n_queries: int, batch: int, inserts: int, ratio: float, steps: int, rounds: int = 1, seed: int = 0) -> list[Event]:
    """A seeded interleaving: query batches in random order, inserts and deletes in steps that grow evenly. The labels
    of all events are shuffled once; the k-th label of a kind is the k-th event of that kind."""
    rng = np.random.default_rng(seed)
    starts = rng.permutation([b for _ in range(rounds) for b in range(0, n_queries, batch)]).astype(int).tolist()
    made = {
        "query": [{"qb": b, "qn": min(batch, n_queries - b)} for b in starts],
        "insert": [{"insert_to": ceil(inserts * i / steps)} for i in range(1, steps + 1)] if inserts > 0 else [],
        "delete": [{"delete_to": ratio * i / steps} for i in range(1, steps + 1)] if ratio > 0 else [],
    }
    labels = rng.permutation([kind for kind, events in made.items() for _ in events]).tolist()
    place = {kind: iter(events) for kind, events in made.items()}
    return [Event(seq, kind, **next(place[kind])) for seq, kind in enumerate(labels)]


def replay(events: list[Event], index: IVFIndex, base: DataFrame, queries: DataFrame, delta: DataFrame, k: int, nprobe: int, n_base: int, mode: str = "flat") -> DataFrame:
    """seq, qid, rank, id, dist of every query event, each against the state that the events before it left."""
    states, rows, ratio = {}, 0, 0.0
    for e in events:
        if e.kind == "insert":
            rows = e.insert_to
        elif e.kind == "delete":
            ratio = e.delete_to
        else:
            states.setdefault((rows, ratio), []).append((e.seq, e.qb, e.qb + e.qn - 1))
    out = None
    for (rows, ratio), asked in states.items():  # one search for each state, whatever the number of batches that meet it
        batches = base.sparkSession.createDataFrame(asked, "seq int, first bigint, last bigint")
        asked = batches.select("seq", F.explode(F.sequence("first", "last")).alias("qid"))
        q = queries.join(F.broadcast(asked.select("qid").distinct()), "qid", "left_semi")
        seen = delta.filter(F.col("id") < n_base + rows) if rows else None
        gone = published_deletes(ratio, n_base)
        found = overlay_search(index, q, k, nprobe, seen, gone, mode).join(F.broadcast(asked), "qid").select("seq", "qid", "rank", "id", "dist")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else base.sparkSession.createDataFrame([], "seq int, qid bigint, rank int, id bigint, dist double")


def update_grid(index: IVFIndex, base: DataFrame, queries: DataFrame, delta: DataFrame, cells: list[tuple[int, float]], nprobes: list[int], k: int, n_base: int) -> DataFrame:
    """inserts, deletes, nprobe, k, hits, total, recall of every cell (inserted rows, deleted ratio) and number of probes,
    against a brute-force search of the rows that are then there."""
    out = None
    for inserts, ratio in cells:
        new, gone = delta.filter(F.col("id") < n_base + inserts), published_deletes(ratio, n_base)
        truth = brute_force_knn(without(base.select("id", "vec").unionByName(new.select("id", "vec")), gone), queries, k, index.metric)
        for nprobe in nprobes:
            found = overlay_search(index, queries, k, nprobe, new if inserts else None, gone)
            one = recall(found, truth, k).select(F.lit(inserts).alias("inserts"), F.lit(ratio).cast("double").alias("deletes"), F.lit(nprobe).alias("nprobe"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def timed_grid(index: IVFIndex, queries: DataFrame, delta: DataFrame, cells: list[tuple[int, float]], batches: list[int], nprobes: list[int], k: int, n_base: int) -> Iterator[dict]:
    """One result row for each cell, batch size and number of probes: milliseconds and queries a second of all batches."""
    place = queries.withColumn("_n", F.row_number().over(Window.orderBy("qid")) - 1).persist()  # a stated query set
    n = place.count()
    for inserts, ratio in cells:
        new, gone = delta.filter(F.col("id") < n_base + inserts) if inserts else None, published_deletes(ratio, n_base)
        for batch in batches:
            for nprobe in nprobes:
                began = time.perf_counter()
                for a in range(0, n, batch):
                    overlay_search(index, place.filter(F.col("_n").between(a, a + batch - 1)).drop("_n"), k, nprobe, new, gone).write.format("noop").mode("overwrite").save()
                ms = 1000 * (time.perf_counter() - began)
                yield {"inserts": inserts, "deletes": ratio, "batch": batch, "nprobe": nprobe, "k": k, "queries": n, "total_ms": round(ms, 3), "qps": round(throughput(n, ms), 3)}
    place.unpersist()
