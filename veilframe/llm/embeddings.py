"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Equal vectors of a label are one class. Rotations of the principal directions are learned that put unit vectors near
the corners of a cube (iterative quantisation); the signs are a binary code. The code is cut into parts, one table each, and
each class enters a table of its label under its part and under every part one bit away, so that any two codes that differ
in at most two bits of some part meet. Classes that meet are compared with their original vectors in double precision, each
pair in one bucket only: the first that the two share. Small buckets give pairs; large ones are cut into chunks whose
pairs are multiplied as matrices and give counts and a spanning forest, not pairs.

How many parts of what width is chosen per vector length from the sample: pairs are made whose cosine is the threshold itself
(a sampled vector, turned into a random direction, or towards another sampled vector), and of the layouts whose parts bring at
least ``RECALL`` of either kind together the one of least expected work is taken. Where vectors share a strong common
direction, signs tell less, and parts become narrower and more; where labels are large, wider. Pairs of small buckets are
dropped before the rerank only if their codes differ in more bits than any of the made pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import U64, lean, random_words
from veilframe.llm.graph import components, each_group
from veilframe.session import cut_lineage

BITS = 64  # of one rotation
#: Width and number of parts.
LAYOUTS = ((24, 8), (20, 5), (20, 8), (16, 4), (16, 8), (13, 8), (12, 10), (10, 8), (10, 12), (9, 14), (8, 12), (8, 16), (6, 20))
RECALL = 0.98
BORDER = 2000  # pairs made of either kind
SAMPLE = 20_000
SMALL = 64
CHUNK = 512


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the directions x bits matrix whose signs are the code."""
    mean = sample.mean(axis=0)
    centered = sample - mean
    _, vectors = np.linalg.eigh(centered.T @ centered)
    directions = vectors[:, ::-1][:, :bits]
    projected = centered @ directions
    noise = random_words(seed, bits * bits).astype(np.float64).reshape(bits, bits) / 2.0 ** 63 - 1
    rotation, _ = np.linalg.qr(noise)
    for _ in range(rounds):
        corners = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(corners.T @ projected)
        rotation = (left @ right).T
    return mean, directions @ rotation


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _signs(units: np.ndarray, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return (units - mean) @ matrix >= 0


def _parts(signs: np.ndarray, width: int, tables: int) -> np.ndarray:
    """The parts of each code as integers: rows x tables."""
    return (signs[:, :width * tables].reshape(-1, tables, width).astype(np.int64) << np.arange(width)).sum(axis=2)


def _border_pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors whose cosine is the threshold, turned at random and towards other vectors of the sample."""
    n, dim = min(BORDER, len(sample)), sample.shape[1]
    here = sample[:n]
    noise = random_words(5, n * dim).astype(np.float64).reshape(n, dim) / 2.0 ** 63 - 1
    found = []
    for direction in (noise, sample[(np.arange(n) * 7919 + len(sample) // 2) % len(sample)]):
        away = direction - (direction * here).sum(axis=1, keepdims=True) * here
        size = np.linalg.norm(away, axis=1)
        some = size > 1e-9
        turned = threshold * here[some] + np.sqrt(max(0.0, 1 - threshold * threshold)) * away[some] / size[some, None]
        found.append((here[some], turned))
    return found


@dataclass(frozen=True)
class Coder:
    """How vectors of one length are coded: signs in a rotation, cut into parts; ``radius`` bits at most differ in a pair."""

    mean: np.ndarray
    matrix: np.ndarray
    width: int
    tables: int
    radius: int
    recall: float

    def parts(self, units: np.ndarray) -> np.ndarray:
        return _parts(_signs(units, self.mean, self.matrix), self.width, self.tables)


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x ^ y) <= 2).any(axis=1)


def choose_coder(sample: np.ndarray, threshold: float, n: float, pairs: float) -> Coder:
    """The rotations and the layout for a sample of unit vectors; ``n`` is the number of vectors they stand for, ``pairs`` that
    of their pairs within labels. At least one of the layouts is taken, the one of best recall if none reaches ``RECALL``."""
    dim = sample.shape[1]
    own = min(BITS, dim)
    most = max(w * t for w, t in LAYOUTS)
    parts = [learn_rotation(sample, own, seed=3 + 11 * i) for i in range(-(-most // own))] if len(sample) > 1 else [(np.zeros(dim), np.eye(dim)[:, :own])]
    mean, matrix = parts[0][0], np.concatenate([m for _, m in parts], axis=1)
    matrix = np.concatenate([matrix] * -(-most // matrix.shape[1]), axis=1)
    border = [(_signs(a, mean, matrix), _signs(b, mean, matrix)) for a, b in _border_pairs(sample, threshold)]
    signs = _signs(sample, mean, matrix)
    other = signs[(np.arange(len(signs)) * 104729 + 1) % max(len(signs), 1)]
    best = None
    for width, tables in LAYOUTS:
        used = width * tables
        recall = min([float(_meet(_parts(a, width, tables), _parts(b, width, tables)).mean()) for a, b in border if len(a)], default=1.0)
        chance = (np.bitwise_count(_parts(signs, width, tables) ^ _parts(other, width, tables)) <= 2).mean() * tables if len(signs) else 0.0
        work = n * tables * (width + 1) + pairs * (chance + 1e-9) * (1 + dim / 64)
        radius = max([int((a[:, :used] != b[:, :used]).sum(axis=1).max()) for a, b in border if len(a)], default=used) + 2
        rank = (recall >= RECALL, -work if recall >= RECALL else recall)
        if best is None or rank > best[0]:
            best = rank, Coder(mean, matrix[:, :used], width, tables, min(radius, used), recall)
    return best[1]


def _models(classes: DataFrame, threshold: float) -> dict[int, Coder]:
    """A coder per vector length, from at most about ``SAMPLE`` classes of it, chosen by a hash (fewer when vectors are
    long: the sample of a length stays below 64 MB)."""
    models = {}
    sizes = classes.groupBy("dim", "label").agg(F.count("*").cast("double").alias("n")).groupBy("dim").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / 2).alias("pairs"))
    for row in sizes.collect():
        dim, share = row["dim"], min(SAMPLE, (8 << 20) // row["dim"] + 1) / row["n"]
        picked = classes.where((F.col("dim") == dim) & (F.pmod("h1", F.lit(1 << 30)) < share * (1 << 30))).orderBy("h1", "h2").select("unit").collect()
        sample = np.array([np.frombuffer(r["unit"]) for r in picked]).reshape(-1, dim)
        models[dim] = choose_coder(sample, threshold, row["n"], row["pairs"])
    return models


def _codes(models: dict[int, Coder]):
    most = max(m.tables for m in models.values()) if models else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            parts, shape = np.zeros((len(dims), most), np.int32), np.zeros((len(dims), 2), np.int32)
            for dim in np.unique(dims):
                at, coder = np.flatnonzero(dims == dim), models[int(dim)]
                parts[at, :coder.tables] = coder.parts(_vectors(batch.column("unit").take(pa.array(at)), int(dim)))
                shape[at] = coder.width, coder.tables
            bounds = pa.array(np.arange(len(dims) + 1, dtype=np.int32) * most)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("label"), batch.column("dim"), pa.ListArray.from_arrays(bounds, pa.array(parts.ravel())),
                 pa.array(shape[:, 0]), pa.array(shape[:, 1])], ["cid", "label", "dim", "code", "width", "tables"])

    return run


def _code_rows(column: pa.Array) -> np.ndarray:
    """The parts of each row: rows x tables (places beyond a length's own tables are all zero)."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1).view(U64)


def _canonical(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table, and the least key in it, under which both codes stand; table -1 if there is none. The last axis are
    the tables."""
    shape = np.broadcast(x[..., 0], y[..., 0]).shape
    table, key = np.full(shape, -1, np.int64), np.zeros(shape, np.int64)
    for j in range(x.shape[-1] - 1, -1, -1):
        a, b = x[..., j], y[..., j]
        differ = a ^ b
        lowest = differ & (~differ + U64(1))
        rest = differ ^ lowest
        meet = (rest & (rest - U64(1) * (rest > 0))) == 0
        top = a.copy()  # the least key one bit around a part clears its highest bit
        for shift in (1, 2, 4, 8, 16, 32):
            top |= top >> U64(shift)
        same = a ^ (top ^ (top >> U64(1)))
        one, two = np.minimum(a, b), np.minimum(a ^ lowest, a ^ rest)
        least = np.where(differ == 0, same, np.where(rest == 0, one, two))
        table = np.where(meet, j, table)
        key = np.where(meet, least.astype(np.int64), key)
    return table, key


def _small_pairs(models: dict[int, Coder]):
    """Pairs of small buckets that have their first meeting there and codes within the radius."""
    radii = {dim: coder.radius for dim, coder in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                rows = np.concatenate([
                    np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "dim", "j", "key", "cid")]),
                    _code_rows(batch.column("code")).view(np.int64).T])
                rows = rows if held is None else np.concatenate([held, rows], axis=1)
                if rows.shape[1] == 0:
                    continue
                new = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
                cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0  # the last bucket may go on
                held, rows = rows[:, cut:], rows[:, :cut]
            else:
                rows = held
            if rows is None or rows.shape[1] < 2:
                continue
            left, right = [], []
            for step in range(1, SMALL):
                same = (rows[:4, step:] == rows[:4, :-step]).all(axis=0)
                if not same.any():
                    break
                i = np.flatnonzero(same)
                left.append(i)
                right.append(i + step)
            if not left:
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            x, y = (np.ascontiguousarray(rows[5:, p].T).view(U64) for p in (i, j))
            dims, of = np.unique(rows[1, i], return_inverse=True)
            near = np.bitwise_count(x ^ y).sum(axis=1) <= np.array([radii[int(d)] for d in dims])[of]
            i, j, x, y = i[near], j[near], x[near], y[near]
            table, key = _canonical(x, y)
            first = (table == rows[2, i]) & (key == rows[3, i])
            a, b = rows[4, i[first]], rows[4, j[first]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["x", "y"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def _rerank(threshold: float):
    """Pairs whose cosine reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                rows = pa.Table.from_batches([batch]).take(at)
                u, v = (_vectors(rows.column(c), int(dim)) for c in ("unit", "other"))
                ok = pa.array(np.einsum("ij,ij->i", u, v) >= threshold)
                yield from rows.select(["x", "y", "x_rows", "y_rows"]).filter(ok).combine_chunks().to_batches()

    return run


def _tile(threshold: float):
    """Counts of linked rows per class of a chunk pair, and edges that span what it links."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        dim, j, key = (rows.column(c)[0].as_py() for c in ("dim", "j", "key"))
        side = rows.column("side").to_numpy()
        unit, code = _vectors(rows.column("unit"), dim), _code_rows(rows.column("code"))
        cid, many = rows.column("cid").to_numpy(), rows.column("m").to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        right = right if rows.column("a")[0].as_py() != rows.column("b")[0].as_py() else left
        if not len(left) or not len(right):
            return None
        linked = unit[left] @ unit[right].T >= threshold
        table, least = _canonical(code[left][:, None], code[right][None])
        linked &= (table == j) & (least == key) & (cid[left][:, None] != cid[right][None])
        forward = linked @ many[right]
        backward = many[left] @ linked if right is not left else np.zeros(len(left), np.int64)
        nodes = np.concatenate([left, right]) if right is not left else left
        # Least reachable place, by repeated minima over the links.
        label, n = np.arange(len(nodes)), len(left)
        while True:
            l_part, r_part = label[:n], label[n:] if right is not left else label
            far = len(nodes)
            to_left = np.minimum(l_part, np.where(linked, r_part[None], far).min(axis=1))
            if right is left:
                new = to_left
            else:
                to_right = np.minimum(r_part, np.where(linked, to_left[:, None], far).min(axis=0))
                new = np.concatenate([to_left, to_right])
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        links = np.concatenate([forward, backward]) if right is not left else forward
        kept = (links > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(cid[nodes][kept]), pa.array(cid[nodes[label]][kept]), pa.array(links[kept].astype(np.int64))],
            ["a", "b", "links"])

    return work


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, links): class a is linked with ``links`` more rows, and reaches class b."""
    models = _models(classes, threshold)
    codes = cut_lineage(classes.select("cid", "label", "dim", "unit").mapInArrow(
        lean(_codes(models)), "cid bigint, label bigint, dim int, code array<int>, width int, tables int"))
    tables = F.posexplode(F.slice("code", F.lit(1), F.col("tables"))).alias("j", "part")
    near = F.explode(F.transform(F.sequence(F.lit(-1), F.col("width") - 1), lambda i: F.when(i < 0, 0).otherwise(F.pow(F.lit(2), i).cast("int"))))
    entries = codes.select("*", tables).select("cid", "label", "dim", "code", "j", "part", near.alias("bit")).select(
        "cid", "label", "dim", "code", "j", F.col("part").bitwiseXOR(F.col("bit")).cast("bigint").alias("key"))
    bucket = ["label", "dim", "j", "key"]
    full = cut_lineage(entries.groupBy(bucket).agg(F.count("*").alias("members")).where("members > 1"))
    met = entries.join(full.hint("merge"), bucket)  # small on disk, large in memory: never broadcast
    pairs = met.where(F.col("members") <= SMALL).select(*bucket, "code", "cid").repartition(*bucket).sortWithinPartitions(
        *bucket, "cid").mapInArrow(lean(_small_pairs(models)), "x bigint, y bigint")
    one = classes.select(F.col("cid").alias("x"), "dim", "unit", F.col("m").alias("x_rows"))
    two = classes.select(F.col("cid").alias("y"), F.col("unit").alias("other"), F.col("m").alias("y_rows"))
    found = pairs.join(one.hint("merge"), "x").join(two.hint("merge"), "y").select("x", "y", "dim", "unit", "other", "x_rows", "y_rows").mapInArrow(
        lean(_rerank(threshold)), "x bigint, y bigint, x_rows bigint, y_rows bigint")
    sparse = found.select(F.explode(F.array(
        F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("y_rows").alias("links")),
        F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("x_rows").alias("links")))).alias("r")).select("r.*")
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    large = met.where(F.col("members") > SMALL).select(
        *bucket, "cid", "code", F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("with"))
    tiles = large.select(*bucket, "cid", "code", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"),
                         (F.col("own") > F.col("with")).cast("int").alias("side"))
    dense = each_group(tiles.join(classes.select("cid", "unit", "m").hint("merge"), "cid"), [*bucket, "a", "b"],
                       _tile(threshold), "a bigint, b bigint, links bigint", ["side", "cid"])
    return sparse.union(dense)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93) -> DataFrame:
    """Per row its identifier, ``n_links``, ``component_id`` and ``kept``.

    Rows of equal labels whose cosine reaches the threshold are linked; ``n_links`` counts the rows linked directly,
    ``component_id`` is the least identifier that links reach, its own included. A row with a null label, or a vector that
    is null, empty, all zero or has a null or non-finite component, links with nothing; vectors of unequal length do not
    link. Equal vectors always do. A null identifier counts as none. Other columns are not read. Empty in, empty out.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(usable, F.lit(False)).alias("usable"),
                          F.col(label_col).cast("bigint").alias("label"), vector.alias("v"))
    # Adding zero makes the two zeros one value, so that hashes and arrays agree.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = cut_lineage(rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", "label", F.lit(1))}))
    grouped = rows.where("usable").groupBy("label", "h1", "h2").agg(
        F.count("*").alias("m"), F.min("id").alias("least_id"), F.min("v").alias("v")).withColumn("cid", F.monotonically_increasing_id())

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for v in batch.column("v").to_pylist():
                x = np.array(v, np.float64)
                x = x / np.abs(x).max()
                out.append((x / np.linalg.norm(x)).tobytes())
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cid", "label", "h1", "h2", "m", "least_id")), pa.array(dims, pa.int32()),
                 pa.array(out, pa.binary())], ["cid", "label", "h1", "h2", "m", "least_id", "dim", "unit"])

    classes = cut_lineage(grouped.select("cid", "label", "h1", "h2", "m", "least_id", "v").mapInArrow(
        lean(unit), "cid bigint, label bigint, h1 bigint, h2 bigint, m bigint, least_id bigint, dim int, unit binary"))
    links = cut_lineage(_links(classes, threshold))
    kin = cut_lineage(components(links.select("a", "b")))
    counts = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    known = classes.select("cid", "h1", "h2", "label", "m", "least_id").join(kin.withColumnRenamed("node", "cid"), "cid", "left").join(
        counts, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    answers = known.join(least, "root").select(
        "label", "h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    matched = rows.select("id", "usable", F.when(F.col("usable"), F.col("label")).alias("label"), "h1", "h2").join(
        answers, ["label", "h1", "h2"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id"))
    return matched.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))
