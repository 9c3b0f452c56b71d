"""Lines whose words are long, against overlapping shingles."""

from stratus.llm import line_dedup

#: (line, the place of the line before it that it is a copy of)
LINES = [
    ("Andththwhes.", None), ("Andththwhwh.", None), ("Inreshated thea.", None), ("Inreshated*** thea.", None),
    ("https://a.example/articles/first-part-of-the-story", None), ("https://a.example/pictures/harbour-at-night", None),
    ("https://a.example/articles/first-part-of-the-story?", 4),
    ("今日は天気がとても良いので公園まで歩いて行きました。そのあと本を読みました。", None), ("今日は天気がとても良いので図書館で友だちと一緒に勉強することにしました。", None),
    ("、今日は天気がとても良いので公園まで歩いて行きました。そのあと本を読みました。", 7),
    ("id-00000000-4f1c22aa90be77", None), ("id-00000000-91d3e8c05b6a12", None),
    ("😀😁😂🤣😃😄😅😆😉😊", None), ("😀😁😂🤣😃😄😅😆😉😎", None),
]


def test_the_whole_line_counts(spark):
    docs = spark.createDataFrame([(0, "\n".join(t for t, _ in LINES))], "doc_id long, text string")
    for t, of in LINES:
        if of is not None:
            a, b = ({s[k : k + 9] for k in range(max(1, len(s) - 8))} for s in (t.strip(), LINES[of][0].strip()))
            assert 100 * len(a & b) >= 80 * len(a | b)
    got = [r.removed for r in line_dedup.removed_lines(docs).collect()]
    assert got == [[k for k, (_, of) in enumerate(LINES) if of is not None]]
