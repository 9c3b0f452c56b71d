"""Merkle manifest of a dataset: a tree of SHA-256 digests for each source, and one over the sources, with a proof for every row.

A leaf is the digest of doc_id, source, lang, n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
Slot pivot: nodes are numbered, FANOUT consecutive ones are a run, and conditional aggregates spread a run over as many
columns. All columns concatenated hash to the parent; the columns before and after a child's own slot are its siblings. Going
down, every node hands its children the siblings on the way to the root, a level at a time, so that tables shrink by FANOUT
with each level and only the lowest runs meet the leaves. Leaves are numbered by range partitions: the rows of earlier partitions
are counted for each source, so a source of any size is spread over many tasks.

Order within a source: doc_id (null first), then the leaf's digest; equal rows are one leaf each, in any order. Null is a source of
its own, before the empty string. Empty texts count as values. Rows without a doc_id are never tampered with. Extra columns play no
part; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratus.llm.common import documents, parts, saved

#: Nodes of a run, columns of a leaf, and of which checksums one row is tampered with.
FANOUT, FIELDS, TAMPERED = 16, ("doc_id", "source", "lang", "n_chars", "text"), 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values one after the other."""
    return F.sha2(F.concat(*values), 256)


def leaf(**columns: Column) -> Column:
    """Digest of a row; ``columns`` replace those of FIELDS."""
    values = [columns.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``at``, the place of each in the order of its group from 0 on; equal rows take places next to each other."""
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = saved(ranged, "merkle-rows").repartitionByRange(parts(rows.sparkSession), group, *order, "tie").withColumn("part", F.spark_partition_id())
    ranged = saved(ranged, "merkle-ranges")
    counts = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows for a group as it has partitions
    before = counts.select(group, "part", (F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "tie")) - 1
    return ranged.join(before, [group, "part"]).withColumn("at", (F.col("before") + place).cast("long")).drop("before", "part", "tie")


def pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, at, c0, c1, ..., node): runs of ``nodes`` (tree, at, node) spread over columns, and the digest of each."""
    slot = F.col("at") % fanout
    runs = nodes.groupBy("tree", F.floor(F.col("at") / fanout).cast("long").alias("at")).agg(*(F.max(F.when(slot == k, F.col("node"))).alias(f"c{k}") for k in range(fanout)))
    return runs.withColumn("node", F.sha2(F.concat_ws("", *(f"c{k}" for k in range(fanout))), 256))


def siblings(slot: Column, fanout: int) -> Column:
    """The columns of a run before and after a slot, concatenated."""
    before = F.concat_ws("", *(F.when(slot > k, F.col(f"c{k}")) for k in range(fanout)))
    after = F.concat_ws("", *(F.when(slot < k, F.col(f"c{k}")) for k in range(fanout)))
    return F.struct(before.alias("before"), after.alias("after"))


def grow(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level from the lowest up, and (tree, height, node): what remains of each tree.

    ``leaves`` has tree, at and node. A tree ends at the level where it has one node, so higher levels lack it.
    """
    sizes = saved(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    levels, tops, nodes, height = [], [], leaves.select("tree", "at", "node"), 0
    while True:
        # n is the number of nodes of a tree at this level
        tops.append(nodes.join(sizes.where("n = 1").select("tree"), "tree", "left_semi").select("tree", F.lit(height).alias("height"), "node"))
        if most <= 1:
            break
        runs = saved(pivot(nodes.join(sizes.where("n > 1").select("tree"), "tree", "left_semi"), fanout), f"merkle-level{height + 1}")
        levels.append(runs)
        nodes, height, most = runs.select("tree", "at", "node"), height + 1, -(-most // fanout)
        sizes = sizes.where("n > 1").select("tree", F.ceil(F.col("n") / fanout).cast("long").alias("n"))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, saved(top, "merkle-tops")


def paths(levels: list[DataFrame], tops: DataFrame, carried: list[str], fanout: int = FANOUT) -> DataFrame:
    """The lowest runs with ``path``, their siblings on the way up, and the columns ``carried`` of their tree.

    ``tops`` has tree, height, path and ``carried``. A tree of one leaf has a row with the place 0 and no run.
    """
    at_height = lambda h: tops.where(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("at"), "path", *carried)
    known = at_height(len(levels))
    for h in range(len(levels), 0, -1):
        runs = levels[h - 1].drop("node").join(known, ["tree", "at"])
        if h == 1:
            return runs.unionByName(at_height(0), allowMissingColumns=True)
        held = F.greatest(*(F.when(F.col(f"c{k}").isNotNull(), k).otherwise(-1) for k in range(fanout)))
        each = runs.withColumn("slot", F.explode(F.sequence(F.lit(0), held)))
        down = each.select("tree", (F.col("at") * fanout + F.col("slot")).alias("at"), F.concat(F.array(siblings(F.col("slot"), fanout)), "path").alias("path"), *carried)
        known = saved(down.unionByName(at_height(h - 1)), f"merkle-paths{h - 1}")
    return known


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where TAMPERED divides the checksum of the id, ``folded_root`` starts from the leaf of the text with its A-Z in lower case.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    other = F.when(tampered, leaf(text=F.translate(F.col("text"), _UPPER, _LOWER)))
    # a tree's name sorts as its source does, null first
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    rows = docs.select("doc_id", tree.alias("tree"), leaf().alias("node"), other.alias("other"))
    leaves = saved(numbered(rows, "tree", "doc_id", "node"), "merkle-leaves")
    levels, tops = grow(leaves, fanout)
    sources = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "height", "node"), "tree", "source")
    sources = saved(sources.withColumnRenamed("height", "low"), "merkle-sources")
    upper, root = grow(sources, fanout)
    root = root.select("node").first()  # one row at most
    if root is None:
        nothing = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
        return leaves.select("doc_id", *(F.lit(None).cast("string").alias(c) for c in nothing[1:]), F.lit(None).cast("boolean").alias("verified"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    ends = paths(upper, root_of(sources, len(upper)), [], fanout).withColumnRenamed("at", "run")
    own = F.when(F.col("c0").isNull(), none).otherwise(F.array(siblings(F.col("at") % fanout, fanout))) if upper else none
    over = sources.withColumn("run", F.floor(F.col("at") / fanout).cast("long")).join(ends, ["tree", "run"])
    over = over.select(F.col("source").alias("tree"), F.col("low").alias("height"), F.concat(own, "path").alias("path"), F.col("node").alias("subroot"))
    lowest = paths(levels, saved(over, "merkle-over"), ["subroot"], fanout).withColumnRenamed("at", "run")
    joined = leaves.withColumn("run", F.floor(F.col("at") / fanout).cast("long")).join(lowest, ["tree", "run"])
    own = F.when(F.col("c0").isNull(), none).otherwise(F.array(siblings(F.col("at") % fanout, fanout))) if levels else none
    full = joined.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root[0]).alias("root"), F.coalesce("other", "node").alias("start"), F.concat(own, "path").alias("path"))
    folded = F.aggregate("path", F.col("start"), lambda node, x: digest(x["before"], node, x["after"]))
    proof = F.sha2(F.concat_ws("", F.flatten(F.transform("path", lambda x: F.array(x["before"], x["after"])))), 256)
    return full.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def root_of(sources: DataFrame, height: int) -> DataFrame:
    """The single tree over the sources as :func:`paths` wants it: nothing is above its root."""
    none = F.array().cast("array<struct<before:string,after:string>>")
    return sources.select("tree").distinct().select("tree", F.lit(height).alias("height"), none.alias("path"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


def _sql(levels: int = 7) -> str:
    """The same rows in SQL: strings of whole runs, cut at a child's place; ``levels`` of 16 children hold 16 ** 7 rows of a source."""
    field = lambda v: f"coalesce(concat(strlen({v}), ':', {v}), '-')"
    whole = lambda text: "sha256(" + " || ".join(field(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT for _ in range(8)]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1))))"
    sql = [f"l0 AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS tree, {whole('text')} AS node, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {whole(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM documents)"]
    sql.append("a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM l0)")

    def climb(tag: str, first: str) -> str:
        sql.append(f"{tag}0 AS (SELECT tree, place, node, n FROM {first})")
        for k in range(levels):
            sql.append(f"{tag}r{k} AS (SELECT tree, place // 16 AS run, string_agg(node, '' ORDER BY place) AS nodes, any_value(n) AS n FROM {tag}{k} GROUP BY tree, place // 16)")
            sql.append(f"{tag}{k + 1} AS (SELECT tree, run AS place, CASE WHEN n > 1 THEN sha256(nodes) ELSE nodes END AS node, (n + 15) // 16 AS n FROM {tag}r{k})")
        return f"{tag}{levels}"

    top = climb("s", "a0")
    sql.append(f"b0 AS (SELECT 0 AS tree, tree AS source, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM {top})")
    root = climb("t", "b0")
    sql.append("p0 AS (SELECT a.*, coalesce(a.other, a.node) AS cur, '' AS proof, b.place AS above, b.node AS subroot FROM a0 a JOIN b0 b ON b.source = a.tree)")
    k = 0
    for tag, tree, place in (("s", "p.tree", "p.place"), ("t", "0", "p.above")):
        for h in range(levels):
            slot = f"({place} >> {4 * h}) % 16"
            left, right = f"substr(r.nodes, 1, 64 * ({slot})::INT)", f"substr(r.nodes, 64 * ({slot})::INT + 65)"
            sql.append(f"p{k + 1} AS (SELECT p.* EXCLUDE (cur, proof), CASE WHEN r.n > 1 THEN sha256({left} || p.cur || {right}) ELSE p.cur END AS cur, CASE WHEN r.n > 1 THEN p.proof || {left} || {right} ELSE p.proof END AS proof FROM p{k} p JOIN {tag}r{h} r ON r.tree = {tree} AND r.run = {place} >> {4 * h + 4})")
            k += 1
    return "WITH " + ",\n".join(sql) + f"\nSELECT p.doc_id, p.node AS leaf, p.subroot, z.node AS root, sha256(p.proof) AS proof_sha256, p.cur AS folded_root, p.cur = z.node AS verified FROM p{k} p CROSS JOIN {root} z"


SQL = _sql()
