"""Near duplicates: a Jaccard join over word shingles by a MinHash LSH forest, with exact verification.

Texts whose sets of five-word shingles are equal form a class and are compared once. Each class has a label in
each of ``TREES`` prefix tries: one 64-bit number, whose ``DEPTH`` equal parts are the low bits of ``DEPTH`` MinHash
values. Labels are computed and stored once; a prefix is a label shifted to the right, so sorted labels are the trie.
Classes that share a prefix in any tree are candidates. A link of similarity s is met with probability
``1 - (1 - s^length)^trees``, so the links found stand for the sum of the reciprocals. The join starts at whole labels. While, in
any band of similarity of width ``BAND``, the links found fall short of ``RECALL`` of the links they stand for, the matched prefixes
are shortened by one value. The *floor* is the length at which even a pair at the threshold is met with ``RECALL``: it always
suffices, so only labels that meet another one at the floor are kept for the rounds (at the default parameters they go from 8
values to at most 6). A round looks only at nodes that the shortening has joined from several, and counts only links that no
longer prefix met, so nothing is counted twice.

Candidates are verified on whole shingle sets, inside blocks of at most ``2 * CHUNK`` classes: the members of a trie
node are dealt to chunks, and each pair of chunks is a block, so no task holds a whole large node. Nodes with the
same members are verified once; a pair that meets in several trees counts in the first of them only. Blocks
return, for each class, how many links it has and the smallest class it hangs together with, never
pairs. Groups then follow from these few edges by repeated minima and pointer jumping, written to the shared folder
after each round.

Defined results: texts without words have an empty set; they are linked with nothing, and each stays a class and
group of its own, as do null texts. A text of fewer than five words is one shingle. Repeated rows and copies share class and group.
Ids may be null or repeated: a class or group is named by its smallest id that is not null. An empty table gives an empty
result. Columns other than the id and text are not touched; the join's own columns are named below.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .text import column, if_small, keep, whole

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999

#: Width of the bands of similarity whose recall is estimated apart, so many close copies don't hide links lost at the threshold.
BAND = 0.02

#: Classes of one trie node that are verified together; two such chunks make a block.
CHUNK = 256

#: Trie nodes with two or more classes (8 bytes each) up to which they are broadcast.
BROADCAST_NODES = 1_000_000

#: Classes with candidates (60 bytes each), or with links or copies, up to which they are broadcast.
BROADCAST_CLASSES = 200_000

#: Words remembered with their hash by each worker; this changes speed only.
MEMORY = 500_000


class _Words(dict):
    """Stable 64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; words are cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - width + 1 + k])
    return np.unique(rolled)


def _functions(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = _mixed(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[: trees * depth] | np.uint64(1), numbers[trees * depth :]


def labels(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, tree by tree."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * factors + offsets).min(axis=0))
    return least


def packed(values: np.ndarray) -> np.ndarray:
    """One number for each row of MinHash values: their low bits, the first value's on top."""
    bits = 64 // values.shape[1]
    label = np.zeros(len(values), np.uint64)
    for k in range(values.shape[1]):
        label = (label << np.uint64(bits)) | (values[:, k] & np.uint64((1 << bits) - 1))
    return label


def _signed(docs: DataFrame, key: str, text: str, trees: int, depth: int) -> DataFrame:
    """Key, digest of the text, digest of its shingle set and its label in each tree."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        known = _Words()
        factors, offsets = _functions(trees, depth)
        for batch in batches:
            digests, found = [], []
            for text in batch["text"]:
                s = shingles(text, known)
                if len(s):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    found.append(packed(_mixed(labels(s, factors, offsets)).reshape(trees, depth)).view(np.int64))
                else:
                    digests.append(None)
                    found.append(np.empty(0, np.int64))
            yield pd.DataFrame({"id": batch["id"], "tid": batch["tid"], "digest": digests, "labels": found})

    taken = docs.select(column(key).alias("id"), F.unhex(F.md5(whole(column(text)))).alias("tid"), whole(column(text)).alias("text"))
    kind = dict(docs.dtypes)[key]
    schema = f"id {kind}, tid binary, digest binary, labels array<bigint>"
    ids = taken.withColumn("id", column("id").cast("string"))
    signed = ids.mapInPandas(sign, schema.replace(f"id {kind}", "id string", 1))
    return signed.withColumn("id", F.col("id").cast(kind))


def floor_length(threshold: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix at which a pair at the threshold is met with probability ``recall``, at least 1."""
    return next((k for k in range(depth, 1, -1) if 1 - (1 - threshold**k) ** trees >= recall), 1)


def _prefix(length: int, depth: int):
    """The first ``length`` values of a label."""
    bits = 64 // depth
    return F.shiftrightunsigned("label", bits * (depth - length))


def _tries(classes: DataFrame, floor: int, depth: int) -> DataFrame:
    """Digest, tree and label wherever another class has the same prefix of the floor's length."""
    placed = classes.select("digest", F.posexplode("labels").alias("tree", "label"))
    node = F.xxhash64("tree", _prefix(floor, depth))
    placed = placed.withColumn("node", node)
    shared = keep(placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "near-nodes")
    return keep(placed.join(if_small(shared, BROADCAST_NODES), "node").select("digest", "tree", "label"), "near-tries")


def _blocks(tries: DataFrame, length: int, depth: int) -> DataFrame:
    """Members of the blocks to verify at this length: block, tree, side (0, 1 or 2 for both) and class.

    Nodes with the same members are taken once, and not at all if a longer prefix had such a node. Of a node of more than
    ``CHUNK`` classes the largest child, whose pairs the longer prefix has verified, meets the others only: its chunks come first
    and make no blocks with each other.
    """
    own, other = F.col("own"), F.col("other")
    placed = tries.withColumn("node", F.xxhash64("tree", _prefix(length, depth)))
    placed = placed.withColumn("child", _prefix(length + 1, depth) if length < depth else F.col("label"))
    children = placed.groupBy("node", "child").agg(
        F.min("tree").alias("tree"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"),
    )
    nodes = children.groupBy("node").agg(
        F.min("tree").alias("tree"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
        F.count(F.lit(1)).alias("children"), F.max(F.struct(F.col("n").alias("size"), "child")).alias("largest"),
    ).where("n > 1")
    old = F.lit(length < depth) & (F.col("children") == 1)
    first = nodes.groupBy("n", "x", "y").agg(
        F.min(F.struct("tree", "node", "largest")).alias("f"), F.bool_or(old).alias("old")
    )
    done = F.when(F.lit(length < depth) & (F.col("n") > CHUNK), F.col("f.largest.size")).otherwise(0)
    nodes = first.where("not old").select(
        "f.tree", "f.node", F.col("f.largest.child").alias("done"), F.ceil(done / CHUNK).cast("int").alias("before"),
        F.ceil((F.col("n") - done) / CHUNK).cast("int").alias("after"),
    )
    members = placed.select("digest", "node", "child").join(nodes, "node")
    verified = (F.col("before") > 0) & (F.col("child") == F.col("done"))
    dealt = F.xxhash64("digest", F.lit(2))
    chunk = F.when(verified, F.pmod(dealt, F.col("before"))).otherwise(F.col("before") + F.pmod(dealt, F.col("after")))
    members = members.withColumn("own", chunk.cast("int"))
    least = F.when(own < F.col("before"), F.col("before")).otherwise(F.lit(0))
    spread = members.withColumn("other", F.explode(F.sequence(least, F.col("before") + F.col("after") - 1)))
    side = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    block = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return spread.select("digest", block.alias("block"), "tree", side.alias("side"))


def _bands(threshold: float) -> int:
    return int((1 - threshold) / BAND) + 1


def _verified(members: DataFrame, trees: int, length: int, depth: int, floor: int, threshold: float) -> DataFrame:
    """Links of each class in each block that no longer prefix met: their number, the documents behind them, their
    number by band of similarity, the links they stand for by length (floor first) and band, and the smallest class that
    hangs together with it."""
    least = Fraction(threshold).limit_denominator(1_000_000)
    p, q = least.numerator, least.denominator
    bits, bands = 64 // depth, _bands(threshold)
    down, longer = np.uint64(bits * (depth - length)), np.uint64(bits * (depth - length - 1)) if length < depth else None

    def block(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.drop_duplicates("digest").sort_values("digest")
        m = len(rows)
        sets = [np.frombuffer(b, np.uint64) for b in rows["hashes"]]
        sizes = np.array([len(s) for s in sets])
        owners = np.repeat(np.arange(m), sizes)
        values, inverse, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(held > 1) - 1
        chosen = held[inverse] > 1
        owners, places = owners[chosen], shared[inverse[chosen]]
        common = np.zeros((m, m), np.float32)
        width = max(256, min(65536, 8_000_000 // m))
        order = np.argsort(places, kind="stable")
        owners, places = owners[order], places[order]
        for start in range(0, int(places[-1]) + 1 if len(places) else 0, width):
            a, b = np.searchsorted(places, [start, start + width])
            has = np.zeros((m, width), np.float32)
            has[owners[a:b], places[a:b] - start] = 1
            common += has @ has.T
        common = common.astype(np.int64)
        linked = common * (p + q) >= p * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        sides = rows["side"].to_numpy()
        linked &= ~((sides[:, None] == sides[None, :]) & (sides[:, None] < 2))
        if not linked.any():
            return None
        own, tree = np.stack(rows["labels"].to_list()).view(np.uint64), int(rows["tree"].iloc[0])
        fresh = linked.copy()
        for t in range(own.shape[1]):
            differ = own[:, t][:, None] ^ own[:, t][None, :]
            if longer is not None:
                fresh &= differ >> longer != 0
            if t < tree:
                fresh &= differ >> down != 0
        similarity = common / np.maximum(1, sizes[:, None] + sizes[None, :] - common)
        a, b = np.nonzero(fresh)
        near = similarity[a, b]
        cell = a * bands + np.minimum(((near - threshold) / BAND).clip(0).astype(int), bands - 1)
        stood = [
            np.bincount(cell, 1 / np.maximum(1 - (1 - near**k) ** trees, 1e-9), m * bands).reshape(m, bands)
            for k in range(floor, depth + 1)
        ]
        seen = np.bincount(cell, minlength=m * bands).reshape(m, bands)
        copies = rows["copies"].to_numpy()
        root = np.arange(m)
        while True:
            lower = np.minimum(root, np.where(linked, root[None, :], m).min(axis=1))
            lower = lower[lower]
            if (lower == root).all():
                break
            root = lower
        digests = rows["digest"].to_numpy()
        some = linked.any(axis=1)
        return pd.DataFrame({
            "digest": digests[some], "texts": fresh.sum(axis=1)[some], "documents": (fresh * copies).sum(axis=1)[some],
            "seen": list(seen[some].astype(float)), "stood": list(np.hstack(stood)[some]), "root": digests[root[some]],
        })

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come in the order of their blocks; the last block of a batch may go on in the next
        open_rows: list[pd.DataFrame] = []
        found: list[pd.DataFrame] = []

        def close() -> None:
            result = block(pd.concat(open_rows) if len(open_rows) > 1 else open_rows[0])
            if result is not None:
                found.append(result)
            open_rows.clear()

        for batch in batches:
            ids = batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if open_rows and b > a and open_rows[0]["block"].iloc[0] != ids[a]:
                    close()
                if b > a:
                    open_rows.append(batch.iloc[a:b])
            if found:
                yield pd.concat(found)
                found.clear()
        if open_rows:
            close()
        yield from found

    schema = "digest binary, texts bigint, documents bigint, seen array<double>, stood array<double>, root binary"
    dealt = members.repartition("block").sortWithinPartitions("block")
    return dealt.mapInPandas(verify, schema)


def groups(edges: DataFrame) -> DataFrame:
    """The smallest node of the connected component of every node of ``edges`` (a, b): columns node, root."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    both = keep(both.where("a <> b").distinct(), "groups-edges")
    state = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "groups")
    while True:
        near = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = state.join(near, state["node"] == near["a"]).select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("was")
        )
        jump = lower.select(F.col("node").alias("at"), F.col("root").alias("to"))
        jumped = lower.join(jump, lower["root"] == jump["at"], "left").select(
            "node", F.coalesce("to", "root").alias("root"), "was"
        )
        after = keep(jumped, "groups")
        state = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return state


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per document: its id, ``tid`` (digest of its text), ``copy_class`` (smallest id with the same shingles),
    ``near_group`` (smallest id of all that hang together by links), ``n_copies`` (documents of its class),
    ``n_links`` (other documents at the threshold or above, copies included) and ``n_linked_texts`` (other classes).
    ``head`` marks the rows that stand for their group: those with its smallest id and, of these, the smallest digest.
    """
    floor = floor_length(threshold, recall, trees, depth)
    signed = keep(_signed(docs, key, text, trees, depth), "near-signed")
    classes = keep(
        signed.where("digest is not null").groupBy("digest").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid")).alias("rep"),
            F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels"),
        ),
        "near-classes",
    )
    tries = _tries(classes, floor, depth)
    links = None
    for length in range(depth, floor - 1, -1):
        members = keep(_blocks(tries, length, depth), "near-members")
        joined = members.join(_sets(docs, classes, members, key, text), "digest")
        found = keep(_verified(joined, trees, length, depth, floor, threshold), "near-links")
        links = found if links is None else links.union(found)
        if length > floor and estimated_recall(links, length - floor, threshold) >= recall:
            break
    return _assembled(signed.drop("labels"), classes.drop("labels"), links)


def estimated_recall(links: DataFrame, place: int, threshold: float) -> float:
    """The least recall over the bands of similarity in which links were found; 1 without links."""
    bands = _bands(threshold)
    sums = [F.sum(F.col("seen")[i]).alias(f"seen{i}") for i in range(bands)]
    sums += [F.sum(F.col("stood")[place * bands + i]).alias(f"stood{i}") for i in range(bands)]
    told = links.agg(*sums).first()
    return min((told[f"seen{i}"] / told[f"stood{i}"] for i in range(bands) if told[f"stood{i}"]), default=1.0)


def _sets(docs: DataFrame, classes: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """The shingle sets of all classes that are candidates, from the text of one document each."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            batch["hashes"] = [shingles(t, known).tobytes() for t in batch.pop("text")]
            yield batch

    wanted = members.select("digest").distinct().join(classes, "digest")
    wanted = keep(wanted.select("digest", "rep.id", "rep.tid", "copies", "labels"), "near-wanted")
    texts = docs.select(column(key).alias("id"), whole(column(text)).alias("text"))
    texts = texts.withColumn("tid", F.unhex(F.md5("text")))
    few = if_small(wanted.select("digest", F.col("id").alias("rid"), "tid"), BROADCAST_CLASSES)
    found = texts.join(few, (texts["tid"] == few["tid"]) & texts["id"].eqNullSafe(few["rid"])).select("digest", "text")
    sets = found.mapInPandas(hashed, "digest binary, hashes binary")
    return wanted.select("digest", "copies", "labels").join(sets, "digest")


def _assembled(signed: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    linked = links.groupBy("digest").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    roots = groups(links.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    info = classes.join(linked, "digest", "left").join(roots, classes["digest"] == roots["node"], "left")
    info = info.where("copies > 1 or texts is not null").select(
        "digest", "copies", "texts", "documents", "rep", F.coalesce("root", "digest").alias("root")
    )
    info = keep(info, "near-info")
    heads = info.groupBy("root").agg(F.min("rep").alias("head"))
    info = info.join(heads, "root").select(
        "digest", "copies", "texts", "documents", F.col("rep.id").alias("class_id"),
        F.col("head.id").alias("group_id"), F.col("head.tid").alias("head_tid"),
    )
    out = signed.select("id", "tid", "digest").join(if_small(keep(info, "near-groups"), BROADCAST_CLASSES), "digest", "left")
    lone = F.col("copies").isNull()
    return out.select(
        "id", "tid",
        F.when(lone, F.col("id")).otherwise(F.col("class_id")).alias("copy_class"),
        F.when(lone, F.col("id")).otherwise(F.col("group_id")).alias("near_group"),
        (lone | (F.col("id").eqNullSafe(F.col("group_id")) & (F.col("tid") == F.col("head_tid")))).alias("head"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("documents", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"),
    )


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """One document of each group: the one with the smallest id (then the smallest text digest).

    Of repeated rows that head a group one stays, whichever; only such rows are shuffled whole.
    """
    found = keep(near_duplicates(docs, key, text, **named), "near-found")
    others = found.where("not head").select("id", "tid").distinct()
    again = found.where("head and n_copies > 1").groupBy("id", "tid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    fate = others.withColumn("repeated", F.lit(False)).union(again.select("id", "tid", F.lit(True).alias("repeated")))
    fate = if_small(keep(fate, "near-fate"), BROADCAST_CLASSES)
    names = docs.columns
    rows = docs.select(
        *[column(c).alias(f"_c{i}") for i, c in enumerate(names)],
        F.xxhash64(column(key)).alias("_k"), F.unhex(F.md5(whole(column(text)))).alias("_tid"),
    )
    same = (rows["_k"] == F.xxhash64(fate["id"])) & (rows["_tid"] == fate["tid"])
    judged = rows.join(fate, same, "left")
    once = judged.where("repeated").dropDuplicates(["_k", "_tid"])
    kept = judged.where("repeated is null").unionByName(once)
    return kept.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)
