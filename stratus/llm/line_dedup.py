"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines are the ``\\n``-separated parts of a text with a non-blank character. A line's set is all its overlapping character
shingles of SHINGLE characters, without its outer blanks; a shorter line is one shingle. ROWS * BANDS minimum hashes are aggregated
map-side; lines that agree in a band are compared with that band's smallest line first, then, where a band's lines do not hang
together yet, in small random groups, and last with each other line of the band that is in another component. Parity sketches of
the sets, which differ in no more bits than the sets do in shingles, rule out pairs without losing one; the Jaccard
similarity of the whole sets confirms each link, with shingles told apart by 64-bit hashes under a key of the run; connected components follow by star steps. Of each component the line that
comes first by (doc_id, text hash, position) stays, all others go, wherever they are; equal lines are always in one component.
Line identity is a 64-bit hash of the line.

Null and empty texts have no lines to remove and stay as they are; blank lines always stay. A row is told by its id and its
text, so rows of one id lose lines each by its own text; rows that have both in common count as one and get the same result.
Rows without an id come last. Extra columns pass through whatever their names are. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import documents, dropped, new_key, plain_text, saved
from stratus.llm.components import components, salted

#: Characters of a shingle, hashes of a band, bands, and the similarity in percent that links two lines.
SHINGLE, ROWS, BANDS, PERCENT = 9, 3, 6, 80
#: Characters that a line's set leaves out at its ends.
BLANK = " \t\r\f\x0b"
#: Lines that a line of a band meets in each of TURNS turns before all pairs that are still apart are compared.
GROUP, TURNS = 16, 2
#: Words of 64 bits in the parity sketch of a line's set, a power of two.
WORDS = 16
#: Shingles that enter a line's sketch together.
STEP = 4
#: Lines of a band that are compared in one task at most.
LEAF = 256
#: Odd multipliers of the minimum hashes, which are over 31 bits.
_MASK = 2**31 - 1
_FACTORS = [(0x9E3779B1 * (2 * k + 1) ** 3 >> 3) % 2**31 | 1 for k in range(ROWS * BANDS)]


def _wide(line: str) -> Column:
    """A line without its outer blanks in UTF-32, where a shingle is a slice of fixed width."""
    return F.encode(F.btrim(F.col(line), F.lit(BLANK)), "UTF-32")


def _last(wide: Column) -> Column:
    """Where the last shingle begins; a shorter line is one shingle."""
    return F.greatest(F.length(wide) - F.lit(4 * SHINGLE - 1), F.lit(1))


def _hashes(line: str, key: int) -> Column:
    """Keyed hashes of all overlapping shingles of a line, in their order."""
    hashed = lambda w: F.transform(F.sequence(F.lit(1), _last(w), F.lit(4)), lambda at: F.xxhash64(F.lit(key), F.substring(w, at, F.lit(4 * SHINGLE))))
    return F.transform(F.array(_wide(line)), hashed)[0]  # an array of one, so that the line is encoded once


def _every(line: str, key: int) -> Column:
    """Keyed hashes of all different overlapping shingles of a line."""
    return F.array_distinct(_hashes(line, key))


def _signs(lines: DataFrame) -> DataFrame:
    """(id, m0, m1, ...): the minimum hashes of ``lines`` (id, line). Two shingles at a time, the last one again where a line has no more."""
    wide = lines.select("id", _wide("line").alias("wide")).select("id", "wide", _last(F.col("wide")).alias("last"))
    dealt = wide.select("id", "wide", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(8))).alias("at"))
    g = [F.expr(f"xxhash64(substring(wide, {at}, {4 * SHINGLE}))").bitwiseAND(F.lit(_MASK)).alias(f"g{j}") for j, at in enumerate(("at", "least(at + 4, last)"))]
    two = dealt.select("id", *g).select("id", *((F.col(f"g{j}") * F.lit(a)).bitwiseAND(F.lit(_MASK)).alias(f"h{j}_{k}") for k, a in enumerate(_FACTORS) for j in (0, 1)))
    # the smaller of two by its difference's sign: no branch, which would go either way as often, and code that is compiled soon
    less = two.select("id", *(F.expr(e) for k in range(len(_FACTORS)) for e in (f"h0_{k} - h1_{k} AS d{k}", f"h1_{k}")))
    return less.groupBy("id").agg(*(F.min(F.expr(f"h1_{k} + (d{k} & shiftright(d{k}, 63))")).alias(f"m{k}") for k in range(len(_FACTORS))))


def _order(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, own, pos, line, id) of all lines with a non-blank character; ``own`` is a hash of the row's text."""
    text = plain_text(text_col)
    rows = docs.select(_order(id_col).alias("doc_id"), F.xxhash64(text).alias("own"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"\S")).withColumn("id", F.xxhash64("line"))


def _sketched(texts: DataFrame) -> DataFrame:
    """``texts`` (id, line) with the set's size n and its parity sketch: bit h of x0, x1, ... is set if an odd number of shingles hash to h."""
    every = texts.select("id", _every("line", new_key()).alias("all")).select("id", "all", F.size("all").cast("long").alias("n"))
    dealt = every.select("id", "n", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(STEP))).alias("at"))
    shingles = dealt.select("id", "n", *(F.expr(f"get(all, at + {j})").alias(f"g{j}") for j in range(STEP)))
    bits = [F.expr(f"if(g{j} IS NULL, 0L, shiftleft(1L, CAST(g{j} & 63 AS INT)))").alias(f"b{j}") for j in range(STEP)]
    words = [F.expr(f"shiftright(g{j}, 6) & {WORDS - 1}").alias(f"w{j}") for j in range(STEP)]
    odd = (F.bit_xor(F.expr(" ^ ".join(f"if(w{j} = {k}, b{j}, 0L)" for j in range(STEP)))).alias(f"x{k}") for k in range(WORDS))
    return texts.join(shingles.select("id", "n", *bits, *words).groupBy("id").agg(F.max("n").alias("n"), *odd), "id")


def _near(percent: int, a: str, b: str) -> str:
    """What holds for every pair of sets that are alike: sizes that are close, and sketches that differ in at most as many bits as the sets in members."""
    bits = " + ".join(f"bit_count({a}x{k} ^ {b}x{k})" for k in range(WORDS))
    return f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n) AND {100 + percent} * ({bits}) <= {100 - percent} * ({a}n + {b}n)"


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, ends: tuple[str, str] = ("id", "other")) -> DataFrame:
    """(u, v): the columns ``ends`` of the pairs (id, other) whose overlapping shingles are alike."""
    a = texts.select("id", *(F.col(c).alias(f"a{c}") for c in texts.columns if c != "id"))
    b = texts.select(F.col("id").alias("other"), *(F.col(c).alias(f"b{c}") for c in texts.columns if c != "id"))
    rows = pairs.join(a, "id").join(b, "other").where(_near(percent, "a", "b"))
    key = new_key()
    both = F.size(F.array_intersect(_hashes("aline", key), _hashes("bline", key)))  # which has no repeats
    # both / (an + bn - both) >= percent / 100, with the intersection named once so that it is computed once
    return rows.where((100 + percent) * both >= percent * (F.col("an") + F.col("bn"))).select(F.col(ends[0]).alias("u"), F.col(ends[1]).alias("v"))


def _meet(rows: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(id, other, comp, ocomp): rows of one band, ``lo`` and ``hi`` from different components, whose ``marks`` do not rule the pair out."""
    # dealt once for both sides; a key has a group of lines or two blocks of them
    rows = rows.select("band", "lo", "hi", "b", "comp", "id").join(marks, "id").repartition("band", "lo", "hi")
    other = rows.select("band", "lo", "hi", *(F.col(c).alias(f"o{c}") for c in rows.columns if c not in ("band", "lo", "hi")))
    met = rows.join(other, ["band", "lo", "hi"]).where(f"id < oid AND comp <> ocomp AND (lo = hi OR b <> ob) AND {_near(percent, '', 'o')}")
    return met.select("id", F.col("oid").alias("other"), "comp", "ocomp").distinct()


def _renamed(rows: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """``rows`` whose components in ``column`` have the names that ``new`` (id, component) gives them."""
    name = new.select(F.col("id").alias(column), F.col("component").alias("name"))
    return rows.join(name, column, "left").withColumn(column, F.coalesce("name", column)).select(*rows.columns)


def _apart(rows: DataFrame) -> DataFrame:
    """(band, id, comp, size): of ``rows`` those in bands that do not hang together yet. Other bands never come apart again."""
    bands = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    return saved(rows.select("band", "id", "comp").join(bands.select("band", "size"), "band"), "rest")


def line_links(lines: DataFrame, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """(u, v): links whose components are those of all confirmed pairs of different lines that share a band; each u has one v, which is no u."""
    band = F.array(*(F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)))
    signs = saved(_signs(lines).select("id", band.alias("bands")), "signs")
    # dealt by band once, for the smallest line of each and for the rows that meet it
    bands = signs.select("id", F.explode("bands").alias("band")).repartition("band")
    pivot = bands.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).where("pivot < most").select("band", "pivot")
    shared = saved(bands.join(pivot.hint("shuffle_hash"), "band"), "shared")
    dropped(signs)
    texts = lines.select("id", "line").join(shared.select("id").distinct().hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])
    plain = saved(texts.select("id", "line"), "texts")
    texts = saved(_sketched(plain), "lines")
    dropped(plain)
    marks = texts.drop("line")
    rest = shared.where("id <> pivot")
    first = saved(rest.select("id", F.col("pivot").alias("other")).distinct(), "pairs")
    joined = saved(components(_confirmed(first, texts, percent)), "joined")
    dropped(first)
    placed = saved(_renamed(rest.select("band", "id", F.col("id").alias("comp")), joined, "comp"), "placed")
    dropped(shared)
    rest = _apart(placed)
    dropped(placed)
    # each line meets about GROUP others of its band first: what hangs together is joined before all pairs are asked for
    turn = 0
    while turn <= TURNS and not rest.isEmpty():
        if turn < TURNS:
            part = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / GROUP)).cast("int")
            dealt = rest.withColumns({"lo": part, "hi": part, "b": part})
        else:  # then every pair across components, large bands block against block
            blocks = F.when(F.col("size") <= leaf, 1).otherwise(F.ceil(F.col("size") * 2 / leaf)).cast("int")
            dealt = rest.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
            dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("b", "o"), "hi": F.greatest("b", "o")})
        pairs = saved(_meet(dealt, marks, percent), "pairs")
        found = saved(_confirmed(pairs, texts, percent, ("comp", "ocomp")), "found")
        dropped(pairs)
        if found.isEmpty():
            dropped(found)
            turn = max(turn + 1, TURNS)
            continue
        # links between components are few; only these are joined, and what they join is renamed
        new = saved(components(found), "new")
        more = _renamed(joined, new, "component").unionByName(new.join(joined, "id", "left_anti"))
        more, old = saved(more, "joined"), joined
        dropped(old, found)
        joined, turn = more, turn + 1
        if turn <= TURNS:
            less, old = _apart(_renamed(rest, new, "comp")), rest
            dropped(old)
            rest = less
        dropped(new)
    dropped(rest, texts)
    return joined.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, own, removed): positions of the lines that go, for rows that lose any; ``own`` is the hash of the row's text, a missing id 2 ** 63 - 1."""
    lines = lines_of(docs, id_col, text_col)
    joined = components(line_links(lines, percent))
    groups = saved(lines.select("doc_id", "own", "pos", "id").join(joined.hint("shuffle_hash"), "id", "left").select("doc_id", "own", "pos", F.coalesce("component", "id").alias("group")), "groups")
    place = F.struct("doc_id", "own", "pos")
    first = groups.groupBy("group").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = salted(groups, first, "group", ("doc_id", "own", "pos")).where(place != F.col("first"))
    return gone.groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the lines that go; nothing else changes."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _order().alias("doc_id"), F.xxhash64(plain_text()).alias("own"))
    whole = keyed.join(removed_lines(docs, percent), ["doc_id", "own"], "left")
    kept = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("row.text"))
    return whole.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the positions of the removed lines, for every document."""
    docs = documents(spark, sf_dir)
    sizes = docs.select(F.col("doc_id").alias("name"), _order().alias("doc_id"), F.xxhash64(plain_text()).alias("own"), F.size(F.split(plain_text(), "\n", -1)).cast("long").alias("n_lines"))
    whole = sizes.join(removed_lines(docs), ["doc_id", "own"], "left")
    return whole.select(F.col("name").alias("doc_id"), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
