"""Jaccard join of word-shingle sets with a count-vector R-tree.

1. Equal sets are one class; the rest works on classes.
2. A set is hashed into as many parts as two linked sets can differ in, and more: some part of at least ``FULL`` shingles
   is then the same in both. Classes that share a part are chained into clusters, by one edge per class and part. Parts travel as
   packed words, 16 bytes each, with a class named by 64 bits: two classes of one name would only be candidates more.
3. The classes of a cluster are points: how many shingles fall into each of ``GROUPS`` groups. They are packed into the
   leaves of an R-tree, by size and then by hash, with the box of each leaf. The overlap of two points is at most the sum
   of their coordinate minima, that of two leaves at most the sum of the minima of their upper corners. Leaf pairs and
   point pairs that cannot reach the threshold go; the others chain points into families.
4. Families are verified on the shingle sets themselves, leaf by leaf and against one hub, then what the hub's component
   has not taken in against every leaf. Pairs that are connected already need no comparison. No pair of texts that
   reaches the threshold is left unconnected, and no step emits more edges than it has rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import U64, free_name, lean, mix, pieces, shingles, signed, utf8, word_hashes
from veilframe.llm.graph import Sets, components, each_group
from veilframe.session import cut_lineage, shuffles_given_back

GROUPS = 64
LEAF = 256
_CHUNK = 1 << 20
_BUCKET = 1 << 18  # keys that are looked at together
_EDGES = "a binary, b binary"
_ROWS = "id bigint, h1 bigint, h2 bigint, sig binary, node bigint, n int, counts binary, keys binary"
_PACKED = "bucket int, is_edges boolean, words binary"


class Rule:
    """Jaccard at least ``percent`` / 100 over shingles of ``size`` words, in whole numbers."""

    def __init__(self, size: int, percent: int) -> None:
        if not 50 < percent <= 100 or size < 1:
            raise ValueError("shingles have a word at least; the similarity is over 50 and at most 100 percent")
        self.size, self.percent = size, percent
        # Parts of at least FULL shingles must outnumber the differences: mean fill of the smallest set of a level.
        self.full, self.fill = (4, 3.6) if percent >= 90 else (2, 1.5) if percent >= 80 else (1, 0.7)

    def differ(self, n: int) -> int:
        """The most shingles in which a set of n and a linked set that is no smaller differ."""
        return n * (100 - self.percent) // self.percent

    def links(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (100 * overlap >= self.percent * (a + b - overlap)) & (overlap > 0)


def _sets(texts: pa.Array, rule: Rule) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingles of each text, some texts at a time."""
    data, bounds = utf8(texts)
    for a, b in pieces(bounds, _CHUNK):
        part = bounds[a:b + 1] - bounds[a]
        codes, at = shingles(*word_hashes(data[bounds[a]:bounds[b]], part), rule.size, whole=True)
        yield [np.unique(codes[at[i]:at[i + 1]]) for i in range(b - a)]


def group_counts(codes: np.ndarray) -> np.ndarray:
    return np.bincount((codes >> U64(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def part_keys(codes: np.ndarray, rule: Rule) -> np.ndarray:
    """A key per part of the set that two linked sets may share; at least one is shared by any two linked sets."""
    n = len(codes)
    if rule.differ(n) == 0:
        return codes[:0]  # only equal sets link
    level = n.bit_length() - 1
    levels = [level] if n * rule.percent >= 100 << level or level == 0 else [level, level - 1]
    out, safe = [], True
    for at in levels:
        parts = max(2, int((1 << at) / rule.fill) + 1)
        part = (mix(codes + U64(at)) >> U64(33)).astype(np.int64) % parts
        size = np.bincount(part, minlength=parts)
        total = np.zeros(parts, U64)
        np.add.at(total, part, mix(codes))
        usable = size >= rule.full
        out.append(mix(total[usable] + mix(np.flatnonzero(usable).astype(U64) + U64(at << 40) + (size[usable].astype(U64) << U64(50)))))
        safe &= int(usable.sum()) > rule.differ(min(n, (2 << at) - 1))  # the smaller set of a pair is of this level
    if not safe:  # two such sets share a shingle among the least ones of each
        out.append(mix(codes[:n - -(-n * rule.percent // 100) + 1] ^ U64(0xA5A5A5A5)))
    return np.unique(np.concatenate(out))


def _describe(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column("text"), rule):
                sig, node, n, counts, keys = [], [], [], [], []
                for codes in sets:
                    n.append(len(codes))
                    sums = np.array([codes.sum(dtype=U64), mix(codes ^ U64(0x1234567)).sum(dtype=U64)], U64)
                    sig.append(sums.tobytes())
                    node.append(int(sums.view(np.int64)[0]))
                    counts.append(group_counts(codes).tobytes())
                    keys.append(part_keys(codes, rule).tobytes())
                rows = batch.slice(at, len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("h1"), rows.column("h2"), pa.array(sig, pa.binary()), pa.array(node, pa.int64()),
                     pa.array(n, pa.int32()), pa.array(counts, pa.binary()), pa.array(keys, pa.binary())],
                    ["id", "h1", "h2", "sig", "node", "n", "counts", "keys"])

    return run


def _stars(keys: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its first node, and the distinct edges from that to the other nodes of the key."""
    order = np.lexsort((node, keys))
    keys, node = keys[order], node[order]
    head = np.r_[True, keys[1:] != keys[:-1]]
    of = node[head][np.cumsum(head) - 1]
    apart = of != node
    of, other = of[apart], node[apart]
    order = np.lexsort((other, of))
    edges = np.stack([of[order], other[order]], axis=1)
    return keys[head], node[head], edges[np.r_[True, (edges[1:] != edges[:-1]).any(axis=1)][:len(edges)]]


def _local_stars(buckets: int):
    """Before the shuffle: each key once per million keys, dealt to buckets and packed with its node, and the edges of the rest."""

    def send(keys: list[np.ndarray], node: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, v, edges = _stars(np.concatenate(keys), np.concatenate(node))
        bucket = (k % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        words = np.stack([k[order], v[order]], axis=1)
        at = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]
        parts = [(b, False, words[at[b]:at[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(at)).tolist()]
        for a in range(0, len(edges), 1 << 14):
            parts.append((int(edges[a, 0] % U64(buckets)), True, edges[a:a + (1 << 14)].tobytes()))
        for a in range(0, len(parts), 64):
            number, is_edges, data = zip(*parts[a:a + 64])
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array(is_edges, pa.bool_()), pa.array(data, pa.binary())], ["bucket", "is_edges", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, node, held = [], [], 0
        for batch in batches:
            cells = batch.column("keys").to_pylist()
            sizes = np.array([len(x) // 8 for x in cells], np.int64)
            if not sizes.sum():
                continue
            keys.append(np.frombuffer(b"".join(cells), U64))
            node.append(np.repeat(batch.column("node").to_numpy().view(U64), sizes))
            held += len(keys[-1])
            if held > 1 << 20:
                yield from send(keys, node)
                keys, node, held = [], [], 0
        if held:
            yield from send(keys, node)

    return run


def _key_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the first node of a key to its others; rows come in the order of buckets, which hold all of a key."""

    def rows(edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(edges[:, 0])), pa.array(signed(edges[:, 1]))], ["a", "b"])

    last, held = None, []
    for batch in batches:
        for number, is_edges, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "is_edges", "words"))):
            words = np.frombuffer(data, U64).reshape(-1, 2)
            if is_edges:
                yield rows(words)
                continue
            if number != last and held:
                yield rows(_stars(*np.concatenate(held).T)[2])
                held = []
            last = number
            held.append(words)
    if held:
        yield rows(_stars(*np.concatenate(held).T)[2])


def _shared_keys(described: DataFrame) -> DataFrame:
    """Edges that chain the nodes which share a key."""
    spark = described.sparkSession
    keys = (described.agg(F.sum(F.octet_length("keys").cast("long"))).first()[0] or 0) // 8
    buckets = max(-(-keys // _BUCKET), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = described.select("node", "keys").mapInArrow(lean(_local_stars(buckets)), _PACKED)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_key_edges), "a bigint, b bigint")


def _star_batch(sets: Sets, sig: list[bytes]) -> pa.RecordBatch:
    """Edges from the least node of each set to its others."""
    heads: dict[int, bytes] = {}
    for i, s in enumerate(sig):
        root = sets.find(i)
        heads[root] = min(s, heads.get(root, s))
    pairs = sorted({(s, heads[sets.find(i)]) for i, s in enumerate(sig) if s != heads[sets.find(i)]})
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], ["a", "b"])


def _bounded(counts: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, rule: Rule) -> np.ndarray:
    """Of ``others`` those points whose sum of coordinate minima with point i can reach the threshold."""
    return others[rule.links(np.minimum(counts[i], counts[others]).sum(axis=1), n[i], n[others])]


def _leaf_join(rule: Rule):
    """Edges that chain the points of a leaf pair which the bound does not part."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        sig = rows.column("sig").to_pylist()
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32).reshape(-1, GROUPS)
        n, side = counts.sum(axis=1), rows.column("side").to_numpy()
        union = Sets(len(sig))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for at, i in enumerate(left):
            for j in _bounded(counts, n, i, right if len(right) else left[at + 1:], rule):
                union.join(int(i), int(j))
        return _star_batch(union, sig)

    return work


def families(classes: DataFrame, clusters: DataFrame, rule: Rule) -> DataFrame:
    """The R-tree join inside clusters: edges between classes that the bounds leave together."""
    points = classes.join(clusters, "node").select("sig", "n", "counts", F.col("root").alias("cluster"))
    # Sizes are cut into bands of a quarter of the ratio that two linked sets can have; a full band is dealt out by hash.
    band = F.floor(F.log("n") / float(-np.log(rule.percent / 100) / 4 + 1e-9)).cast("int") if rule.percent < 100 else F.col("n")
    points = points.withColumn("band", band)
    per = points.groupBy("cluster", "band").agg(F.count("*").alias("m")).withColumn(
        "leaves", F.ceil(F.col("m") / LEAF).cast("int"))
    points = cut_lineage(points.join(per, ["cluster", "band"]).select(
        "cluster", "band", F.pmod(F.xxhash64("sig"), F.col("leaves")).cast("int").alias("leaf"), "sig", "n", "counts"))

    def box(rows: pa.Table) -> pa.RecordBatch:
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32).reshape(-1, GROUPS)
        n = counts.sum(axis=1)
        return pa.RecordBatch.from_arrays(
            [rows.column("cluster").combine_chunks().slice(0, 1), pa.array([rows.column("band")[0].as_py()], pa.int32()),
             pa.array([rows.column("leaf")[0].as_py()], pa.int32()), pa.array([int(n.min())], pa.int32()),
             pa.array([int(n.max())], pa.int32()), pa.array([counts.max(axis=0).tolist()], pa.list_(pa.int32()))],
            ["cluster", "band", "leaf", "least", "most", "upper"])

    lone = per.groupBy("cluster").agg(F.sum("m").alias("m")).where("m > 1").select("cluster")
    boxes = cut_lineage(each_group(points.join(lone, "cluster", "left_semi"), ["cluster", "band", "leaf"], box,
                                   "cluster bigint, band int, leaf int, least int, most int, upper array<int>"))
    # Linked sizes are at most five bands apart, so leaves meet by an equi-join on the band.
    left = boxes.select("cluster", *[F.col(c).alias(f"l_{c}") for c in ("band", "leaf", "least", "most", "upper")],
                        F.explode(F.sequence(F.col("band"), F.col("band") + (5 if rule.percent < 100 else 0))).alias("r_band"))
    right = boxes.select("cluster", *[F.col(c).alias(f"r_{c}") for c in ("band", "leaf", "least", "most", "upper")])
    overlap = F.least(
        F.aggregate(F.zip_with("l_upper", "r_upper", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x),
        F.least("l_most", "r_most"))
    pairs = left.join(right, ["cluster", "r_band"]).where(
        (F.struct("l_band", "l_leaf") <= F.struct("r_band", "r_leaf"))
        & (overlap * (100 + rule.percent) >= rule.percent * (F.col("l_least") + F.col("r_least")))
        & (F.col("r_least") * rule.percent <= F.col("l_most") * 100) & (F.col("l_least") * rule.percent <= F.col("r_most") * 100))
    pairs = cut_lineage(pairs.select("cluster", "l_band", "l_leaf", "r_band", "r_leaf"))
    ends = []
    for side, end in enumerate("lr"):
        own = pairs if side == 0 else pairs.where("l_band <> r_band OR l_leaf <> r_leaf")
        ends.append(own.join(points, (own["cluster"] == points["cluster"]) & (F.col(f"{end}_band") == F.col("band"))
                             & (F.col(f"{end}_leaf") == F.col("leaf"))).select(
            own["cluster"], "l_band", "l_leaf", "r_band", "r_leaf", F.lit(side).alias("side"), "sig", "counts"))
    return each_group(ends[0].union(ends[1]), ["cluster", "l_band", "l_leaf", "r_band", "r_leaf"], _leaf_join(rule), _EDGES,
                      ["side", "sig"])


def _verify(rule: Rule):
    """Edges between texts that link: hub (role 0) and leaf (1) all against all, what is left over (2) against the leaf."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        sig, role = rows.column("sig").to_pylist(), rows.column("role").to_numpy()
        known = rows.column("component").to_pylist()
        sets = [s for part in _sets(rows.column("text").combine_chunks(), rule) for s in part]
        counts = np.array([group_counts(s) for s in sets])
        n = np.array([len(s) for s in sets])
        union, linked, heads = Sets(len(sig)), Sets(len(sig)), {}
        for i, c in enumerate(known):
            if c is not None:
                union.join(heads.setdefault(c, i), i)
        own = np.flatnonzero(role < 2)
        rest = np.flatnonzero(role == 2)
        for at, i in enumerate(own):
            for j in _bounded(counts, n, i, rest if len(rest) else own[at + 1:], rule):
                if union.find(int(i)) == union.find(int(j)):
                    continue
                small, large = sorted((sets[i], sets[j]), key=len)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if rule.links(int((large[place] == small).sum()), n[i], n[j]):
                    union.join(int(i), int(j))
                    linked.join(int(i), int(j))
        return _star_batch(linked, sig)

    return work


def _verified(members: DataFrame, rule: Rule) -> DataFrame:
    """``node`` and ``root`` of the classes linked with others, from members (family, sig, text)."""
    sizes = members.groupBy("family").agg(F.count("*").alias("m"), F.min("sig").alias("hub"))
    paged = cut_lineage(members.join(sizes, "family").select(
        "family", "sig", "text", "hub", F.ceil(F.col("m") / LEAF).cast("int").alias("pages"),
        F.pmod(F.xxhash64("sig"), F.ceil(F.col("m") / LEAF)).cast("int").alias("page")))
    fields = ["family", "page", "part", "role", "sig", "text", "component"]
    none, zero = F.lit(None).cast("binary").alias("component"), F.lit(0).alias("part")
    hubs = paged.where("sig = hub AND pages > 1").select("family", "sig", "text", none, zero, F.lit(0).alias("role"),
                                                         F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"), F.col("page").alias("own"))
    first = paged.select("family", "page", zero, F.lit(1).alias("role"), "sig", "text", none).select(fields).union(
        hubs.where("page <> own").select(fields))
    keys = ["family", "page", "part"]
    edges = cut_lineage(each_group(first, keys, _verify(rule), _EDGES, ["role", "sig"]))
    wide = paged.where("pages > 1")
    if wide.isEmpty():
        return components(edges)
    # What the component of the hub has not taken in meets every page of its family, a page of it at a time.
    found = cut_lineage(components(edges))
    wide = wide.join(found, F.col("sig") == F.col("node"), "left").withColumn("component", F.coalesce("root", "sig")).drop("node", "root")
    center = wide.where("sig = hub").select("family", F.col("component").alias("center"))
    loose = wide.join(center, "family").where("component <> center")
    counts = loose.groupBy("family").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("parts"))
    loose = loose.join(counts, "family").select(
        "family", "sig", "text", "component", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("parts")).cast("int").alias("part"),
        F.lit(2).alias("role"), F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page")).select(fields)
    pages = wide.join(counts, "family").select(
        "family", "page", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "sig",
        "text", "component").select(fields)
    more = each_group(pages.union(loose), keys, _verify(rule), _EDGES, ["role", "sig"])
    return components(edges.union(more))


def _classified(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The described rows (id, h1, h2, sig, n, ...), and sig, root and component_id of every class with shingles."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h1"),
                       F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))
    described = cut_lineage(rows.mapInArrow(lean(_describe(rule)), _ROWS))
    narrow = described.select("id", "h1", "h2", "sig", "node", "n", "counts").where("n > 0")
    classes = cut_lineage(narrow.groupBy("sig").agg(
        F.min("id").alias("least_id"), F.min(F.struct("h1", "h2")).alias("of"), F.max("node").alias("node"), F.max("n").alias("n"),
        F.max("counts").alias("counts")))
    clusters = cut_lineage(components(_shared_keys(described)))
    kin = cut_lineage(components(families(classes, clusters, rule)))
    members = classes.join(kin.withColumnRenamed("node", "sig"), "sig").select("sig", "of.h1", "of.h2", F.col("root").alias("family"))
    texts = rows.select("h1", "h2", "text").join(members, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("family", "sig", "text")
    linked = cut_lineage(_verified(texts, rule))
    least = classes.join(linked.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least_id", F.coalesce("root", "sig").alias("root"))
    return described, least.join(least.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select(
        "sig", "root", "component_id")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """Per row its identifier, ``n_shingles`` and ``component_id``: the least identifier that links reach, its own included.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text with fewer than ``size`` words is one shingle. Null,
    empty and wordless texts have no shingle and link with nothing. Equal sets link, whatever the texts. Rows that repeat
    an identifier are taken for what their texts are; a null identifier counts as none, and a component that has no
    other gives null. Other columns are not read. Empty in, empty out.
    """
    with shuffles_given_back(docs.sparkSession):  # the tables of each step are written: what was shuffled for them can go
        described, labels = _classified(docs, id_col, text_col, Rule(size, percent))
    return described.select("id", "sig", "n").join(labels, "sig", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with their columns, but one row only of each component: that of the least identifier (rows
    without one come last, then the text's hash decides). Rows without shingles all stay; of rows that repeat both
    identifier and text one stays."""
    with shuffles_given_back(docs.sparkSession):  # the tables of each step are written: what was shuffled for them can go
        described, labels = _classified(docs, id_col, text_col, Rule(size, percent))
    rank = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0).cast("bigint")).alias("id"), "h1", "h2")
    rooted = described.where("n > 0").select("sig", rank.alias("rank")).join(labels.select("sig", "root"), "sig")
    best = rooted.groupBy("root").agg(F.min("rank").alias("best"))
    key, h1, h2 = (free_name(docs.columns, c) for c in ("row_key", "hash_1", "hash_2"))
    nothing = F.lit(np.iinfo(np.int64).min)
    gone = rooted.join(best, "root").where("rank <> best").select(
        F.when(F.col("rank.none"), nothing).otherwise(F.col("rank.id")).alias(key), F.col("rank.h1").alias(h1), F.col("rank.h2").alias(h2)).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("bigint"), nothing), h1: F.xxhash64(text), h2: F.xxhash64(text, F.lit(1))})
    return keyed.join(gone, [key, h1, h2], "left_anti").dropDuplicates([key, h1, h2]).select(*docs.columns)
