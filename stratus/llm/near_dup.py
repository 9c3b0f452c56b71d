"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Equal sets are one vertex. TREES independent trees start with
one minwise value each as root node. A node of more than LEAF sets first contracts: its sets are confirmed on full sets
against a central one, and if all of them hang together already the node is done, for no further link could change a
component. Otherwise it branches: the path chooses minwise coordinates, BRANCH of them on average, and every set goes to the
child of its value there. Nodes of at most LEAF sets with LEAF_SHINGLES shingles are compared exhaustively: signatures
first, then full sets. Nodes that do not get small in DEPTH levels are compared block against block, so nothing is capped. ``recall`` has the share of
pairs that meet in a leaf: 0.996 at the threshold of 0.85 even if both are in large nodes on all levels.

Null, empty and blank texts give an empty set and are linked with nothing. Rows repeated under one ``doc_id`` are judged
each by its own text; those without an id take part, and a component's id is the smallest one it has (null if it has none,
then no row of it is kept). Ties take the smallest id. Extra columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import binary, by_key, documents, dropped, mix, new_key, pieces, prefix_hash, saved, substring_hash, utf8, whole_groups, words
from stratus.llm.components import components

#: Words of a shingle, minwise coordinates, trees, sets and shingles of a leaf, levels below the root, chosen coordinates of a node on average.
WORDS, COORDS, TREES, LEAF, LEAF_SHINGLES, DEPTH, BRANCH = 5, 128, 8, 4096, 8_000_000, 12, 1.4
#: Sets of a large node among which its central one is looked for (on average), sets that one task compares with it.
SAMPLE, STAR = 64, 256
_A = np.random.default_rng(20240501).integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall(similarity: float, trees: int = TREES, depth: int = DEPTH, branch: float = BRANCH) -> float:
    """Share of pairs of a similarity that meet in a leaf if all nodes above it are large."""
    lost = 0.0
    for _ in range(depth):
        one = 1 - similarity + similarity * lost
        lost = (2 - branch) * one + (branch - 1) * one * one
    return 1 - (1 - similarity * (1 - lost)) ** trees


def shingle_sets(data: np.ndarray, offsets: np.ndarray, key: int, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, n + 1 bounds)."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, doc = words(data, offsets)
    n = len(offsets) - 1
    w = substring_hash(prefix_hash(data, key), start, end, key)
    count = np.bincount(doc, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    h = np.zeros(len(w), np.uint64)
    if len(w) >= k:
        m = len(w) - k + 1
        for j in range(k):
            h[:m] = mix(h[:m] + w[j : m + j], j + 1)
    out = []
    for d in range(n):
        i, c = at[d], count[d]
        if c >= k:
            out.append(np.unique(h[i : i + c - k + 1]))
        elif c:
            v = np.zeros(1, np.uint64)
            for j in range(c):
                v = mix(v + w[i + j : i + j + 1], j + 1)
            out.append(mix(v, 100 + int(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _sign(key: int):
    """Set size, 128-bit sum of the set and minwise signature of every document."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                sets, at = shingle_sets(data, offsets, key)
                size = np.diff(at)
                full = np.flatnonzero(size)
                sign = np.full((len(size), COORDS), 2**32 - 1, np.uint32)
                sums = np.zeros((2, len(size)), np.uint64)
                if len(full):
                    cut = at[full]
                    for c in range(COORDS):
                        sign[full, c] = np.minimum.reduceat(((sets * _A[c]) >> np.uint64(32)).astype(np.uint32), cut)
                    for k in (0, 1):
                        sums[k, full] = np.add.reduceat(mix(sets, 7 + k), cut)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), binary(sign.reshape(-1).view(np.uint8), np.arange(len(size) + 1) * COORDS * 4)], ["doc_id", "tie", "n_shingles", "s1", "s2", "sign"])

    return f


def signatures(docs: DataFrame, key: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, n_shingles, s1, s2, sign) of every document; ``sign`` is COORDS little-endian uint32 values, ``tie`` a hash of the text. Only those of one ``key`` compare."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(_sign(key), "doc_id long, tie long, n_shingles long, s1 long, s2 long, sign binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return utf8(column)[0].view(np.uint32).reshape(-1, COORDS)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sign, ids = _matrix(batch.column("sign")), batch.column("id").to_numpy()
        for t in range(TREES):
            path = mix(sign[:, t].astype(np.uint64) + np.uint64(t << 32), 1)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(np.full(len(ids), t, np.int32)), pa.array(ids)], ["path", "tree", "id"])


def _branch(level: int):
    """Children of the rows of large nodes: one chosen coordinate, and a second one with probability BRANCH - 1."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign, path = _matrix(batch.column("sign")), batch.column("path").to_numpy().view(np.uint64)
            rows = np.arange(len(path))
            for k in (0, 1):
                dice = mix(path, 50 + 2 * level + k)
                take = rows if not k else rows[(dice >> np.uint64(40)).astype(float) / 2**24 < BRANCH - 1]
                coord = (dice[take] % np.uint64(COORDS)).astype(np.int64)
                child = mix(path[take] + mix(sign[take, coord].astype(np.uint64) + (coord.astype(np.uint64) << np.uint64(32)), 2), 3 + k)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("tree").take(pa.array(take)), batch.column("id").take(pa.array(take))], ["path", "tree", "id"])

    return f


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node's sample the set whose signature has most of the values that are the most frequent ones."""
    for table, bounds in whole_groups(batches, "path"):
        sign, best = _matrix(table.column("sign")), []
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            m = sign[i:j]
            often = np.zeros(m.shape, np.int64)
            for row in m:
                often += m == row
            best.append(i + int(np.argmax((often == often.max(axis=0)).sum(axis=1))))
        rows = table.take(pa.array(best))
        yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in ("path", "id", "sign")], ["path", "pivot", "pivot_sign"])


def _close(cut: float):
    """(id, pivot) of rows whose signature is like their pivot's."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.count_nonzero(_matrix(batch.column("sign")) == _matrix(batch.column("pivot_sign")), axis=1) >= int(np.ceil(cut * COORDS))
            yield batch.select(["id", "pivot"]).filter(pa.array(near))

    return f


class Join:
    """The links found so far, and their components."""

    def __init__(self, rows: DataFrame, sets: DataFrame, percent: int, key: int):
        self.rows, self.sets, self.percent, self.key = rows, sets, percent, key
        self.links: list[DataFrame] = []
        self.joined: DataFrame | None = None

    def with_comp(self, members: DataFrame, id_col: str = "id", comp: str = "comp") -> DataFrame:
        if self.joined is None:
            return members.withColumn(comp, F.col(id_col))
        return members.join(self.joined.select(F.col("id").alias(id_col), F.col("component").alias("found")), id_col, "left").withColumn(comp, F.coalesce("found", id_col)).drop("found")

    def shingles(self, wanted: DataFrame) -> DataFrame:
        """(id, shingles) of the sets in ``wanted`` (id), from the first text that has each of them."""
        first = self.sets.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "s1", "s2", F.col("first.doc_id").alias("d"), F.col("first.tie").alias("t"))
        texts = self.rows.join(first.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("tie").eqNullSafe(F.col("t"))).select("id", "s1", "s2", "text").dropDuplicates(["id"])
        return saved(texts.mapInArrow(_sets(self.key), "id long, shingles binary"), "shingles")

    def confirm(self, groups: DataFrame, star: bool = False) -> None:
        """Adds the links of groups (path, part, id, comp, first): of all pairs, or of pairs with the first row only."""
        texts = self.shingles(groups)
        full = groups.join(texts, "id").select("path", "part", "first", "id", "comp", "shingles")
        self.links.append(saved(by_key(full, "path", "part", order=("first", "id")).mapInArrow(_confirm(self.percent, star), "u long, v long"), "found"))
        dropped(texts)
        links = self.links[0]
        for more in self.links[1:]:
            links = links.unionByName(more)
        old, self.joined = self.joined, components(links)
        dropped(old)


def _contract(join: Join, large: DataFrame, cut: float) -> DataFrame:
    """Confirms the sets of large nodes (path, tree, id, n, sign) against a central one; the nodes that still hold several components."""
    sample = large.where(F.pmod(F.xxhash64("id", "path"), F.col("n")) < SAMPLE)
    pivots = saved(by_key(sample.select("path", "id", "sign"), "path", order=("id",)).mapInArrow(_pivots, "path long, pivot long, pivot_sign binary"), "pivots")
    close = large.join(pivots, "path").where("id <> pivot").select("id", "pivot", "sign", "pivot_sign").mapInArrow(_close(cut), "id long, pivot long").distinct()
    apart = saved(join.with_comp(join.with_comp(close), "pivot", "comp2").where("comp <> comp2").select("id", "pivot", "comp", "comp2"), "star")
    if apart.isEmpty():
        dropped(pivots, apart)
        return large
    number = apart.groupBy("pivot").agg(F.max("comp2").alias("comp"), F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    dealt = apart.join(number.select("pivot", "parts"), "pivot").select(F.col("pivot").alias("path"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "comp", F.lit(1).alias("first"))
    heads = number.select(F.col("pivot").alias("path"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("id"), "comp", F.lit(0).alias("first"))
    join.confirm(dealt.unionByName(heads), star=True)
    mixed = join.with_comp(large.select("path", "id")).groupBy("path").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("path")
    left = saved(large.join(mixed, "path", "left_semi"), "mixed")
    dropped(pivots, apart)
    return left


def leaves(join: Join, cut: float, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(path, tree, id): the small nodes of all trees, with at least two sets each."""
    schema, signs = "path long, tree int, id long", join.sets.select("id", "sign")
    sizes = join.sets.select("id", "n_shingles")
    nodes, out, large = saved(signs.mapInArrow(_roots, schema), "roots"), None, None
    for level in range(depth + 1):
        weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n_shingles") * leaf / LEAF_SHINGLES))
        size = nodes.join(sizes, "id").groupBy("path").agg(F.count(F.lit(1)).alias("several"), weight.alias("n")).where("several > 1").drop("several")
        sized = saved(nodes.join(size, "path"), "nodes")
        dropped(nodes, large)
        small = sized.where(F.col("n") <= leaf).drop("n")
        out = small if out is None else out.unionByName(small)
        large = sized.where(F.col("n") > leaf)
        if large.isEmpty():
            return out
        whole = saved(large.join(signs, "id").select("path", "tree", "id", "n", "sign"), "large")
        large = _contract(join, whole, cut)
        if large is not whole:
            dropped(whole)
        if large.isEmpty():
            return out
        if level < depth:
            nodes = saved(large.mapInArrow(_branch(level), schema).distinct(), "branch")
    blocks = F.ceil(F.col("n") * 2 / leaf).cast("int")
    own = large.withColumn("b", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.unionByName(own.select(F.xxhash64("path", F.least("b", "o"), F.greatest("b", "o")).alias("path"), "tree", "id"))


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _alike(cut: float):
    """Rows of leaves whose signatures are alike; ``part`` numbers the parts of a leaf that hang together."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = int(np.ceil(cut * COORDS))
        for table, bounds in whole_groups(batches, "path"):
            sign = _matrix(table.column("sign")).astype(np.uint16)
            keep, part = [], []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                n = j - i
                if n == 2:
                    if np.count_nonzero(sign[i] == sign[i + 1]) >= least:
                        keep += [i, i + 1]
                        part += [0, 0]
                    continue
                parent = list(range(n))
                for a in range(n - 1):
                    near = np.flatnonzero(np.count_nonzero(sign[i + a + 1 : j] == sign[i + a], axis=1) >= least)
                    for b in near.tolist():
                        x, y = _find(parent, a), _find(parent, a + 1 + b)
                        parent[max(x, y)] = min(x, y)
                roots = [_find(parent, a) for a in range(n)]
                count = np.bincount(roots, minlength=n)
                for a, r in enumerate(roots):
                    if count[r] > 1:
                        keep.append(i + a)
                        part.append(r)
            if keep:
                rows = table.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([rows.column("path").combine_chunks(), rows.column("tree").combine_chunks(), rows.column("id").combine_chunks(), pa.array(part, pa.int32())], ["path", "tree", "id", "part"])

    return f


def _sets(key: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                sets, at = shingle_sets(data, offsets, key)
                yield pa.RecordBatch.from_arrays([rows.column("id"), binary(sets.view(np.uint8), at * 8)], ["id", "shingles"])

    return f


def _confirm(percent: int, star: bool):
    """Links between full sets: 100 * intersection >= percent * union. A group that hangs together is compared no further."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "path", "part"):
            data, at = utf8(table.column("shingles"))
            allsets, at = data.view(np.uint64), at // 8
            ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
            us, vs = [], []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                n, size = j - i, np.diff(at[i : j + 1])
                if n == 2:
                    if comp[i] != comp[i + 1] and min(size) * 100 >= percent * max(size):
                        both = len(np.intersect1d(allsets[at[i] : at[i + 1]], allsets[at[i + 1] : at[i + 2]], assume_unique=True))
                        if both * 100 >= percent * (size.sum() - both):
                            us.append(ids[i])
                            vs.append(ids[i + 1])
                    continue
                code = np.unique(allsets[at[i] : at[j]], return_inverse=True)[1]
                lo, root = at[i:j] - at[i], np.unique(comp[i:j], return_inverse=True)[1]
                flag = np.zeros(code.max() + 1, bool)
                for a in range(1 if star else n - 1):
                    others = np.flatnonzero(root[a + 1 :] != root[a]) + a + 1
                    if not len(others):
                        if (root == root[0]).all():
                            break
                        continue
                    mine, span = code[lo[a] : lo[a] + size[a]], size[others]
                    begin = np.cumsum(span) - span
                    flag[mine] = True
                    both = np.add.reduceat(flag[code[np.repeat(lo[others] - begin, span) + np.arange(span.sum())]], begin, dtype=np.int64)
                    flag[mine] = False
                    for b in others[both * 100 >= percent * (size[a] + span - both)].tolist():
                        if root[a] != root[b]:
                            root[root == root[b]] = root[a]
                            us.append(ids[i + a])
                            vs.append(ids[i + b])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return f


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, depth: int = DEPTH, more: tuple[str, ...] = (), hash_key: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked id), kept (it is its own component_id).

    ``more`` may add ``tie``, the xxhash64 of the text, to tell rows of one id apart. Shingles are hashed under ``hash_key``, a new secret one by
    default, so which pairs the trees miss differs by run; two different shingles agree with a chance of about their bytes in 2 ** 61.
    """
    threshold = percent / 100
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    hash_key = new_key() if hash_key is None else hash_key
    signed = saved(signatures(rows, hash_key), "signatures")
    key = ["n_shingles", "s1", "s2"]
    best = F.min_by(F.struct("doc_id", "tie"), F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "tie"))
    firsts = saved(signed.where("n_shingles > 0").groupBy(*key).agg(best.alias("first")).withColumn("id", F.monotonically_increasing_id()), "firsts")
    own = firsts.select("id", *key, "first", F.col("first.doc_id").alias("d"), F.col("first.tie").alias("t"))
    one = signed.select(*(F.col(c).alias(f"own_{c}") for c in key), "doc_id", "tie", "sign")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("t").eqNullSafe(F.col("tie"))
    for c in key:
        same = same & (F.col(c) == F.col(f"own_{c}"))
    sets = saved(own.join(one, same).dropDuplicates(["id"]).select("id", *key, "first", "sign"), "sets")
    cut = threshold - 3.5 * (threshold * (1 - threshold) / COORDS) ** 0.5
    join = Join(rows, sets, percent, hash_key)
    near = by_key(leaves(join, cut, leaf, depth).join(sets.select("id", "sign"), "id").select("path", "tree", "id", "sign"), "path")
    members = saved(near.mapInArrow(_alike(cut), "path long, tree int, id long, part int"), "members")
    for turn in ("tree = 0", "tree > 0"):
        now = join.with_comp(members.where(turn))
        apart = now.groupBy("path", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("path", "part")
        join.confirm(now.join(apart, ["path", "part"], "left_semi").select("path", "part", "id", "comp", F.lit(1).alias("first")))
    linked = join.joined.join(sets.select("id", "first.doc_id"), "id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    ids = linked.select("id", "component").join(least, "component").select("id", "least")
    whole = firsts.join(ids.withColumn("linked", F.lit(True)), "id", "left").select(*key, F.when(F.col("linked"), F.col("least")).otherwise(F.col("first.doc_id")).alias("comp"))
    out = signed.select("doc_id", *more, *key).join(whole, key, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
