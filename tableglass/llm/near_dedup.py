"""Near duplicates by a chosen-path join: sets of word shingles are split on sampled shared tokens until the groups are small."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import give_back, lookup, small_batches, stored
from tableglass.llm.packed import MOST_ROWS, NO_ID, Chunk, chunked
from tableglass.llm.words import mix, window_hashes, word_hashes

SHINGLE = 5
LIMIT = 800  # sets compared with each other in one group
DEPTH = 3
BINS = 64  # of a set's sketch
PRESELECT = 64.0


def miss(runs: int, depth: int = DEPTH) -> float:
    """The probability that a pair at the threshold, whose groups are split ``depth`` times, does not meet in so many runs.

    Such a pair shares PRESELECT preselected tokens a level on average (Poisson), and all nodes of all runs choose a
    PRESELECTth of these. So the runs are independent only once the levels' shared tokens are given: with k of them a pair
    survives a level with 1 - (1 - survival of the rest / PRESELECT) ** k.
    """
    k = np.arange(int(PRESELECT + 12 * math.sqrt(PRESELECT)) + 1)
    chance = np.exp(k * math.log(PRESELECT) - PRESELECT - np.array([math.lgamma(x + 1) for x in k.tolist()]))
    survival = weight = np.ones(1)
    for _ in range(depth):
        survival, weight = (1 - (1 - survival[:, None] / PRESELECT) ** k).ravel(), (weight[:, None] * chance).ravel()
        survival, weight = survival[weight > 1e-13], weight[weight > 1e-13]
    return float((weight * (1 - survival) ** runs).sum() + max(0.0, 1 - weight.sum()))


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """The least runs after which a pair at the threshold has met with probability ``recall``, if all its groups are split to ``depth``."""
    runs = 1
    while miss(runs, depth) > 1 - recall:
        runs += 1
    return runs


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; a text of fewer words, but not none, has one."""
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else words


def chunk_sets(chunk: Chunk, wanted: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    words, starts, _ = word_hashes(chunk.data, lower=True)
    firsts = chunk.firsts(starts).tolist()
    for i in range(len(chunk.ids)) if wanted is None else wanted:
        yield i, shingles(words[firsts[i]:firsts[i + 1]])


def _children(tokens: np.ndarray, nodes: np.ndarray, share: float, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(number of the parent, child): the tokens that each node samples, a ``share``th of these, as names of the child nodes."""
    h = nodes[:, None] ^ tokens[None, :]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= seed
    parents, at = np.nonzero(h < np.uint64(min(2.0 ** 64 - 2048, 2.0 ** 64 / share)))
    return parents, mix(h[parents, at])


def paths(tokens: np.ndarray, threshold: float, runs: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level (parents, nodes) of a set: in every node it is in, each of its n tokens leads on with probability
    1 / (threshold * n), by hashes of token, level and node, so that sets which share the token go the same way. A level first
    takes PRESELECT times as many tokens for all its nodes, then each node its part of them."""
    least = 2.0 ** 64 * PRESELECT / (threshold * max(len(tokens), 1))
    nodes = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = []
    for level in range(depth):
        seed = np.uint64(pow(0x9E3779B97F4A7C15, 2 * level + 3, 1 << 64))
        some, share = tokens, PRESELECT
        if least < 2.0 ** 64:
            h = (tokens ^ (tokens >> np.uint64(29))) * seed
            some = tokens[(h ^ (h >> np.uint64(32))) * seed < np.uint64(least)]
        else:  # a small set: its nodes choose among all tokens
            share = max(1.0, threshold * len(tokens))
        parents, nodes = _children(some, nodes, share, seed)
        out.append((parents, nodes))
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One byte of the least hash in each of BINS bins, 0 for an empty bin."""
    h = mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A))
    least = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    bins = (h >> np.uint64(58)).astype(np.int64)
    np.minimum.at(least, bins, h & np.uint64((1 << 58) - 1))
    return np.where(np.bincount(bins, minlength=BINS) > 0, 1 + (mix(least) % np.uint64(255)), 0).astype(np.uint8)


SETS = ("row bigint, id bigint, n bigint, s1 bigint, s2 bigint, sketch binary, l1 array<bigint>, p2 array<int>, l2 array<bigint>, "
        "p3 array<int>, l3 array<bigint>")


def record(chunk: int, k: int) -> int:
    """The number of the k-th document of a chunk: 23 bits for the task that made the chunk, 20 for its chunk, 20 for the document."""
    return ((chunk >> 32) << 40) | ((chunk & 0xFFFFFFFF) << 20) | k


def _sets(chunks: DataFrame, threshold: float, runs: int) -> DataFrame:
    """A row for each document: its set's size, hash and sketch, and its nodes at the three levels."""
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, out = Chunk(*(batch.column(j)[i].as_py() for j in range(4))), []
                for k, tokens in chunk_sets(chunk):
                    (_, l1), (p2, l2), (p3, l3) = paths(tokens, threshold, runs, 3)
                    s1, s2 = (int(mix(tokens ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (0x1234567, 0xFEDCBA9876543))
                    out.append((record(chunk.chunk, k), None if chunk.ids[k] == NO_ID else int(chunk.ids[k]), len(tokens), s1, s2, sketch(tokens).tobytes(),
                                l1.view(np.int64), p2.astype(np.int32), l2.view(np.int64), p3.astype(np.int32), l3.view(np.int64)))
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*out), fields)], [f for f, _ in fields])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*out), fields)], [f for f, _ in fields])
                del chunk, out
                give_back()
    return stored(chunks.mapInArrow(run, SETS), "sets")


def _leaves(reps: DataFrame, limit: int, total: int) -> DataFrame:
    """(leaf, rec): the groups in which sets are compared. A node with more than ``limit`` sets is left to its children; at the
    last level it is cut into blocks, with a group for each two of them."""
    found, level = [], reps.select("rec", F.explode("l1").alias("node"))
    for depth in (1, 2, 3):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        level = stored(lookup(level, sizes, ["node"], "size", total * 16), "nodes")
        found.append(level.filter(F.col("size") <= limit).select(F.col("node").alias("leaf"), "rec"))
        large = level.filter(F.col("size") > limit)
        if large.isEmpty():
            break
        if depth == 3:
            blocks = F.ceil(F.col("size") / (limit // 2)).cast("int")
            own = F.pmod(F.xxhash64("rec"), blocks).cast("int")
            pairs = large.select("node", "rec", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            found.append(pairs.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), "rec"))
        else:
            above, below = (f"l{depth}", f"l{depth + 1}")
            step = reps.select("rec", above, F.explode(F.arrays_zip(F.col(f"p{depth + 1}").alias("p"), F.col(below).alias("node"))).alias("z")).select(
                "rec", F.get(F.col(above), F.col("z.p")).alias("parent"), "z.node")
            parents = large.groupBy("node").agg(F.first("size").alias("size"))
            kept = lookup(step, parents.select(F.col("node").alias("parent"), "size"), ["parent"], "size", total * 16)
            level = kept.select("rec", "node").distinct()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _unseen(leaf: int, lists: list[np.ndarray]) -> np.ndarray:
    """Pairs (upper triangle) that have no smaller group in common, so that a pair is looked at once however often it meets."""
    m = len(lists)
    fresh = np.triu(np.ones((m, m), bool), 1)
    who = np.repeat(np.arange(m), [len(x) for x in lists])
    every = np.concatenate(lists)
    who, every = who[every < leaf], every[every < leaf]
    order = np.argsort(every, kind="stable")
    who, every = who[order], every[order]
    cuts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]).tolist() if len(every) else []
    for a, b in zip(cuts, [*cuts[1:], len(every)]):
        if b - a > 1:
            fresh[np.ix_(who[a:b], who[a:b])] = False
    return fresh


def _similar_sizes(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9


def _alike(sketches: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the pairs whose sketches agree in so many bins that they may reach the threshold (five standard deviations below it)."""
    out = np.zeros_like(pairs)
    first, second = np.nonzero(pairs)
    for a in range(0, len(first), 1 << 14):
        i, j = first[a:a + (1 << 14)], second[a:a + (1 << 14)]
        x, y = sketches[i], sketches[j]
        some = np.maximum(((x > 0) | (y > 0)).sum(axis=1), 1)
        same = ((x == y) & (x > 0)).sum(axis=1)
        out[i, j] = same / some >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / some)
    return out


def _needed(members: DataFrame, threshold: float) -> DataFrame:
    """(leaf, rec) of the sets that have to be looked at in a group, judged by sizes, sketches and the other groups. Groups are
    dealt out in buckets of many, none of which is larger than a few groups."""
    total = members.count()

    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks().sort_by("leaf")
        leaf, n = np.asarray(bucket.column("leaf")), np.asarray(bucket.column("n"))
        sketches = np.frombuffer(b"".join(bucket.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        leaves, keep = bucket.column("leaves"), np.zeros(len(leaf), bool)
        cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(leaf)]):
            pairs = np.triu(_similar_sizes(n[a:b], threshold), 1)
            if pairs.any() and (pairs := _alike(sketches[a:b], pairs, threshold)).any():
                pairs &= _unseen(int(leaf[a]), [np.asarray(x.values) for x in leaves.slice(a, b - a)])
                keep[a:b] = pairs.any(axis=0) | pairs.any(axis=1)
        return bucket.select(["leaf", "rec"]).filter(pa.array(keep))
    buckets = F.pmod(F.xxhash64("leaf"), F.lit(total // 5000 + 1))
    return members.groupBy(buckets.alias("bucket")).applyInArrow(run, "leaf bigint, rec bigint")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[token] > 1
    who, token = who[shared], token[shared]
    number = np.cumsum(counts > 1) - 1
    token, n_shared = number[token], int(number[-1]) + 1
    out, width = np.zeros((m, m), np.float32), max(256, min(n_shared, (1 << 23) // m))
    order = np.argsort(token, kind="stable")
    who, token = who[order], token[order]
    for a in range(0, n_shared, width):
        part = slice(*np.searchsorted(token, [a, a + width]))
        x = np.zeros((m, width), np.float32)
        x[who[part], token[part] - a] = 1
        out += x @ x.T
    return out


def _compared(shipped: DataFrame, threshold: float) -> DataFrame:
    """(rec, root, links): in each group, every set's component and how many documents it is linked to there."""
    def run(group: pa.Table) -> pa.Table:
        leaf, group = group.column("leaf")[0].as_py(), group.combine_chunks()
        sets = [np.frombuffer(x.as_py(), "<u8") for x in group.column("tokens")]
        n, rec, copies = np.array([len(s) for s in sets]), np.asarray(group.column("rec")), np.asarray(group.column("copies"))
        common = _intersections(sets)
        linked = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6
        linked &= _unseen(leaf, [np.asarray(x.values) for x in group.column("leaves")])
        linked |= linked.T
        root = rec.copy()
        while True:  # to the least number in reach
            new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == root).all():
                break
            root = new
        found = pa.table({"rec": rec, "root": root, "links": linked @ copies}).filter(pa.array(linked.any(axis=1)))
        if len(sets) > LIMIT // 4:
            del sets, common, linked
            give_back()
        return found
    return stored(shipped.groupBy("leaf").applyInArrow(run, "rec bigint, root bigint, links bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(rec, label): the least rec that each one reaches over edges (rec, root). Labels spread to neighbours and jump along
    themselves, round by round; every round is stored."""
    both = edges.filter("rec != root").distinct()
    both = stored(both.unionByName(both.select(F.col("root").alias("rec"), F.col("rec").alias("root"))).distinct(), "edges")
    total = both.count()
    labels = stored(both.groupBy("rec").agg(F.least("rec", F.min("root")).alias("label"), F.count(F.lit(1)).alias("degree")), "labels")
    while True:
        near = lookup(both, labels.select(F.col("rec").alias("root"), F.col("label").alias("other"), "degree"), ["root"], "degree", total)
        least = near.groupBy("rec").agg(F.min("other").alias("other"))
        spread = labels.join(least, "rec").select("rec", F.least("label", "other").alias("next"), "label", "degree")
        followers = spread.groupBy("next").agg(F.count(F.lit(1)).alias("n"))
        target = spread.select(F.col("rec").alias("next"), F.col("next").alias("further")).join(followers, "next")
        moved = stored(lookup(spread, target, ["next"], "n", total).select(
            "rec", F.col("further").alias("label"), "degree", (F.col("further") != F.col("label")).alias("moved")), "labels")
        labels = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return labels.select("rec", "label")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, limit: int = LIMIT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, class_id, n_links, class_size, kept), one row for each document.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles (A-Z lower-cased; a text of fewer
    words is one shingle) is ``threshold`` or more; a class is what links connect. ``n_links`` counts the linked documents, copies
    too; ``class_id`` is the smallest id of the class. ``kept`` marks one row of each class, that with the smallest id. A text
    without words (null, empty) is linked to nothing and alone in its class. Null ids come last; of repeated rows in a class one is
    kept. Other columns are not read. An empty table gives an empty result.

    Texts with equal sets are one record. Each run starts with all records in one group; a group is split by the tokens that it
    samples of its sets, 1 / (threshold * n) of a set's n tokens. Groups of up to ``limit`` records are compared in full and exactly;
    larger ones are split again, and after three splits cut into blocks. There are as many runs as bring a pair at the threshold
    together with probability ``recall`` even if all its groups are split three times (more, if they are not), counting that runs
    share preselected tokens. A pair is looked
    at in its smallest group only, so links are counted once, and no pairs leave the task: just components and numbers.
    """
    small_batches(docs.sparkSession)
    chunks = chunked(docs, id_col, text, "texts")
    every = _sets(chunks, threshold, runs_for(recall))
    total = every.count()
    words = every.filter("n > 0")
    key = ["s1", "s2", "n"]
    groups = words.groupBy(*key).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = stored(lookup(words.select("row", "id", *key), groups, key, "copies", total).select("row", "id", "rep", "copies"), "members")
    some = members.filter("row = rep").select(F.col("rep").alias("rec"), "copies")
    reps = stored(words.withColumnRenamed("row", "rec").drop("id", "s1", "s2").join(some, "rec"), "records")
    leaves = stored(_leaves(reps, limit, total), "groups")
    lists = leaves.groupBy("rec").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    facts = reps.select("rec", "n", "copies", "sketch").join(lists, "rec")
    of_leaf = facts.select("*", F.explode("leaves").alias("leaf"))
    needed = stored(_needed(of_leaf, threshold), "needed").groupBy("rec").agg(F.collect_list("leaf").alias("to"))
    orders = needed.join(facts.select("rec", "copies", "leaves"), "rec").select(
        F.expr("shiftleft(shiftright(rec, 40), 32) | (shiftright(rec, 20) & 1048575L)").alias("chunk"), F.struct("rec", "copies", "to", "leaves").alias("order")).groupBy("chunk").agg(
            F.collect_list("order").alias("orders"))  # no more than a chunk's documents

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(*(batch.column(j)[i].as_py() for j in range(4)))
                orders = {o["rec"] & (MOST_ROWS - 1): o for o in batch.column(4)[i].as_py()}
                for k, tokens in chunk_sets(chunk, sorted(orders)):
                    o, raw = orders[k], tokens.astype("<u8").tobytes()
                    n = len(o["to"])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(o["to"], pa.int64()), pa.array([o["rec"]] * n, pa.int64()), pa.array([o["copies"]] * n, pa.int64()),
                        pa.array([o["leaves"]] * n, pa.list_(pa.int64())), pa.array([raw] * n, pa.binary())], ["leaf", "rec", "copies", "leaves", "tokens"])
    shipped = chunks.join(orders, "chunk").mapInArrow(ship, "leaf bigint, rec bigint, copies bigint, leaves array<bigint>, tokens binary")
    links = _compared(shipped, threshold)
    labels = components(links.select("rec", "root"))
    linked = labels.join(links.groupBy("rec").agg(F.sum("links").alias("links")), "rec", "left").join(some, "rec")
    linked = linked.select(F.col("rec").alias("rep"), "label", F.coalesce("links", F.lit(0)).alias("links"), F.col("copies").alias("group_rows"))
    placed = lookup(members, linked, ["rep"], "group_rows", total, how="left").select(
        "row", "id", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = every.filter("n = 0").select("row", "id", F.col("row").alias("label"), F.lit(0).cast("long").alias("n_links"))
    placed = stored(placed.unionByName(alone), "placed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = placed.groupBy("label").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return lookup(placed, classes, ["label"], "class_size", total).select(
        F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "n_links", "class_size", (F.col("row") == F.col("first.row")).alias("kept"))
