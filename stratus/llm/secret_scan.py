"""Secrets in texts: three fixed rules, and Markov models of random strings and of ordinary identifiers.

All of it is DataFrame functions. A rule's matches and the pieces between them (``regexp_extract_all`` and ``split``) give
code-point spans. Strings of MIN_RUN or more identifier characters outside those spans are candidates. Two first-order
character models are trained from labelled samples: of random strings (values that the rules matched in the corpus, and the
uniform distribution) and of ordinary ones (the identifiers of ORDINARY, written for this purpose, and long words of letters in the
corpus). Each sample backs off from steps to single characters by the number of different followers (Witten-Bell), so a step
that a sample never has still counts for what its characters are worth. A candidate is a secret if its mean log-likelihood ratio reaches
RATIO. The counts cover the whole corpus and are bounded by the alphabet; ``ratios`` can be taken once and passed to
``scan``, which makes verdicts independent of the documents at hand.

Null is an empty text (``redact`` leaves it null). Repeated rows and rows without an id are scanned and redacted each by its own
text; extra columns stay out of it; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import documents, plain_text, saved

#: Fixed patterns: kind, expression, group whose length counts, least length.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Characters of a candidate, its least length, and the mean ratio in nats a step from which it is a secret.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN, RATIO = 16, 0.45
#: Ordinary identifiers, paths, dates and numbers that are no secrets.
ORDINARY = """
get_user_name_by_id set_default_encoding MAX_CONNECTION_COUNT DEFAULT_TIMEOUT_SECONDS parseHttpRequestHeader HTTPServerConnection XMLHttpRequestFactory
getElementsByTagName addEventListener java_util_concurrent org_example_project some-long-css-class-name background-image-large data-toggle-button
src/main/resources/config home/user/documents/report images/gallery/photo articles/2021/05/first-story index_2023_final_version release-notes-version-2
2024-01-15-12-30-45 2021_06_30_backup 1999-12-31/2000-01-01 1234567890123456 0000000000000000 4111-1111-1111-1111 49-30-1234567-890 user12345678901234
test_case_number_0042 chapter-10-section-3 version_1_2_3_release Windows10Professional utf8_general_ci_charset sha256_checksum_file base64_encode_string md5sum_of_the_file
ISO8859_character_set IPv6AddressPattern localhost_port_8080 python3_virtualenv_path camelCaseIdentifierName PascalCaseClassName snake_case_function_name
SCREAMING_SNAKE_CASE CONFIG_FILE_LOCATION ERROR_CODE_NOT_FOUND ENVIRONMENT_VARIABLE abstractFactoryBuilder isValidEmailAddress toStringRepresentation onClickListener1
========================= ------------------------- _________________________ +++++++++++++++++++ temperature=23 key=value/path=name a+b+c+d+e+f+g+h+i+j
international/organisation understanding-responsibility characteristics_overview telecommunications counterrevolutionary incomprehensibilities
Donaudampfschifffahrt anticonstitutionnellement electroencefalografista ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789
""".split()
_RUN = f"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def _spans(t: str, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Matches of ``pattern`` in column ``t`` as (start, rank, stop, kind, value)."""
    text, rx = F.col(t), F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    value = F.regexp_extract_all(text, rx, F.lit(group)) if group else found
    step = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), found.alias("whole"), value.alias("value"))
    out = F.aggregate(
        step,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.coalesce(x["gap"], F.lit(0)) + F.coalesce(F.length(x["whole"]), F.lit(0))).alias("at"),
            F.when(
                F.length(x["value"]) >= least,
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (a["at"] + x["gap"] + F.length(x["whole"])).alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value")))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast(_SPAN))


def _pairs(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))


def _steps(counts: dict[str, float]) -> list[list[float]]:
    """Probability of each step a → b from counts of two-character strings, backed off to single characters and to the uniform distribution."""
    n = len(ALPHABET)
    place = {c: k for k, c in enumerate(ALPHABET)}
    table = [[0.0] * n for _ in range(n)]
    for step, count in counts.items():
        if step[0] in place and step[1] in place:
            table[place[step[0]]][place[step[1]]] += count
    single = [sum(row[b] for row in table) for b in range(n)]
    kinds, total = sum(x > 0 for x in single), sum(single)
    single = [(x + kinds / n + 1 / n) / (total + kinds + 1) for x in single]
    out = []
    for row in table:
        kinds, total = sum(x > 0 for x in row), sum(row)
        out.append([(x + (kinds + 1) * single[b]) / (total + kinds + 1) for b, x in enumerate(row)])
    return out


def ratio_table(random: dict[str, float], ordinary: dict[str, float]) -> list[float]:
    """Log-likelihood ratio of each step a → b at place a * n + b, from the corpus's counts of steps and the fixed samples."""
    fixed: dict[str, float] = {}
    for word in ORDINARY:
        for k in range(len(word) - 1):
            fixed[word[k : k + 2]] = fixed.get(word[k : k + 2], 0) + 1
    n = len(ALPHABET)
    seen, written, plain = _steps(random), _steps(fixed), _steps(ordinary)
    return [math.log((seen[a][b] + 1 / n) / (written[a][b] + plain[a][b])) for a in range(n) for b in range(n)]


def ratios(found: DataFrame) -> list[float]:
    """The table of ratios from all documents of ``found`` (base, runs)."""
    random = found.select(F.lit(1).alias("random"), F.explode("base.value").alias("token"))
    plain = found.select(F.lit(0).alias("random"), F.explode("runs.value").alias("token")).where(F.col("token").rlike("^([A-Za-z]?[a-z]+|[A-Z]+)$"))
    steps = random.unionByName(plain).where("length(token) > 1").select("random", F.explode(_pairs(F.col("token"))).alias("step"))
    counts: list[dict[str, float]] = [{}, {}]
    for r in steps.where(F.col("step").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "step").count().collect():  # at most two rows for each pair of the alphabet
        counts[r["random"]][r["step"]] = r["count"]
    return ratio_table(counts[1], counts[0])


def _mean_ratio(token: Column, weights: list[float]) -> Column:
    table = F.array(*(F.lit(round(w, 6)) for w in weights))  # folded to one literal
    n = len(ALPHABET)
    code = lambda p, k: F.instr(F.lit(ALPHABET), F.substring(p, k, 1)) - 1
    total = F.aggregate(_pairs(token), F.lit(0.0), lambda a, p: a + F.element_at(table, code(p, 1) * n + code(p, 2) + 1))
    return total / (F.length(token) - 1)


def _candidates(t: str) -> tuple[Column, Column]:
    """Spans of the rules in column ``t``, and runs of identifier characters that touch none of them."""
    base = F.sort_array(F.concat(*(_spans(t, kind, k, *rest) for k, (kind, *rest) in enumerate(RULES))))
    return base, _spans(t, "markov", len(RULES), _RUN, 0, MIN_RUN)


def _free(runs: str, base: str) -> Column:
    return F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, weights: list[float] | None = None) -> DataFrame:
    """(doc_id, base, markov): spans of the rules and further spans of the models, each (start, rank, stop, kind, value)."""
    text = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("t"))
    base, runs = _candidates("t")
    first = text.select("doc_id", base.alias("base"), runs.alias("runs"))
    found = saved(first.select("doc_id", "base", _free("runs", "base").alias("runs")), "secrets")
    table = weights or ratios(found)
    return found.select("doc_id", "base", F.filter("runs", lambda r: _mean_ratio(r["value"], table) >= ratio).alias("markov"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", ratio: float = RATIO, weights: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced by ``mask``; overlapping spans are one.

    Each row is cleaned by itself: its columns travel as one struct beside its spans, so no join has to find it again.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), plain_text("text").alias("t"))
    base, runs = _candidates("t")
    first = rows.select("row", base.alias("base"), runs.alias("runs"))
    found = saved(first.select("row", "base", _free("runs", "base").alias("runs")), "secrets")
    table = weights or ratios(found)
    hits = F.filter("runs", lambda r: _mean_ratio(r["value"], table) >= ratio)
    spans = found.select("row", F.sort_array(F.concat("base", hits)).alias("spans"))
    text = F.col("row.text")
    whole = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)).alias("out"), s["stop"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["stop"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    cleaned = F.when(F.size("spans") > 0, whole).otherwise(text)
    return spans.select(*(cleaned.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "markov"))).alias("spans"))
