"""Rows that share an id, have none or have columns named like internal ones; recall on all overlapping shingles."""

from stratus.llm import line_dedup


def test_rows_of_one_id_lose_their_own_lines(spark):
    rows = [(2, "a line that comes again and again", 1), (2, "and keep this as well please\na line that comes again and again", 2), (None, "a line that comes again and again\nx", 3), (None, None, 4), (5, "", 5)]
    docs = spark.createDataFrame([(i, t, n, "r", "o", 3) for i, t, n in rows], "doc_id long, text string, removed int, row string, own string, pos int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.removed: r.text for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[4] is None and got[5] == "" and got[3] == "x"
    assert sorted([got[1], got[2]]) in (["", "a line that comes again and again\nand keep this as well please"], ["", "and keep this as well please\na line that comes again and again"], ["a line that comes again and again", "and keep this as well please"])


def test_recall_on_a_table(spark):
    """Against all pairs of the lines of sf0.001 that have 80 % of their shingles in common."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = sorted({x for r in docs.collect() for x in (r.text or "").split("\n") if x.strip(" \t\r\f\x0b")})
    sets = [{s[k : k + 9] for k in range(max(1, len(s) - 8))} for s in (x.strip(" \t\r\f\x0b") for x in lines)]
    where: dict[str, list[int]] = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = set()
    for k, s in enumerate(sets):
        count: dict[int, int] = {}
        for x in s:
            for j in where[x]:
                if j < k:
                    count[j] = count.get(j, 0) + 1
        pairs |= {(j, k) for j, n in count.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)}
    from stratus.llm.components import components

    rows = line_dedup.lines_of(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string"))
    group = {r.id: r.component for r in components(line_dedup.line_links(rows)).collect()}
    ids = {r.doc_id: r.id for r in rows.collect()}
    found = sum(group.get(ids[a], ids[a]) == group.get(ids[b], ids[b]) for a, b in pairs)
    assert pairs and found >= 0.95 * len(pairs)
