"""Secret scans with DataFrame operations only: fixed patterns, and Markov models of strings.

Two first-order Markov models over characters are trained from labelled samples: values that
the fixed patterns find (random strings) and ordinary words (identifiers). A token whose
log-likelihood ratio per transition exceeds a threshold is a secret of kind ``random``.

Spans are (kind, start, end) in code points, end exclusive.

Edge cases: a null text is empty. Texts without a hit have no spans. Where the documents hold no
sample of one kind, its model is the uniform one. Repeated rows are scanned alike. Other columns pass
through, except those named like results.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: (kind, expression, group whose length counts, least length), fixed by the contract of the query.
#: Where the whole match counts, the least length stands in the expression: a match of the shorter
#: form takes all of its run, so it fails or passes alike.
BASE = [
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
]
#: What a text must contain for the kind to be looked for at all. Each follows from the expression.
HINTS = {
    "assign": r"(?i)(?=[apst])(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA[A-Z0-9]",
    "hex": "[0-9a-f]{32}",
}
#: Tokens that the models judge, if they hold a digit.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
CANDIDATE_HINT = "[A-Za-z0-9+/_-]{20}"
THRESHOLD = 0.4
#: Documents whose ordinary words train the identifier model; the expected number of the sample.
SAMPLE_DOCS = 20_000
CODES = 128


def _spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """Spans of the matches of ``pattern`` for which ``keep(match)`` holds, leftmost first.

    Splitting by the pattern gives the gaps, so starts are running sums of gaps and matches.
    """
    each = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.char_length(gap).alias("gap"), match.alias("match")),
    )  # the last gap has no match
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["match"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("value")
        )
        out = F.when(keep(x["match"]), F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(each, first, step, lambda acc: acc["out"])


def _long_enough(pattern: str, group: int, least: int):
    def keep(match):
        value = F.regexp_extract(match, pattern, group) if group else match
        return F.char_length(value) >= least

    return keep


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")


def base_spans(text: Column) -> Column:
    """Spans of all fixed kinds: by kind as listed, then by start."""
    found = []
    for kind, pattern, group, least in BASE:
        hit = F.coalesce(text, F.lit("")).rlike(HINTS[kind])
        spans = _spans(text, kind, pattern, _long_enough(pattern, group, least))
        found.append(F.when(hit, spans).otherwise(_none()))
    return F.concat(*found)


def _transitions(tokens: DataFrame, name: str) -> DataFrame:
    """Counts of (code, next code) over the characters of ``token``, as many times as ``n`` says."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.char_length("token") - 1),
        lambda i: F.ascii(F.substring("token", i, 1)) * CODES + F.ascii(F.substring("token", i + 1, 1)),
    )
    return (
        tokens.where(F.char_length("token") >= 2)
        .select(F.explode(pairs).alias("pair"), "n")
        .groupBy("pair")
        .agg(F.sum("n").alias(name))
    )


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio of every transition, at index code * 128 + next code.

    Random strings: the values of all fixed-pattern hits of all documents. Identifiers: the
    ASCII words, without digits, of about ``sample_docs`` documents drawn by a hash of the id.
    Both are counted per distinct word before they are cut into transitions. The model has one
    number per pair of ASCII codes, whatever the corpus.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = docs.where(
        text.rlike("|".join([HINTS["access"], HINTS["hex"]])) | text.rlike(HINTS["assign"])
    ).select(F.explode(base_spans(F.col("text"))).alias("s"))
    value = F.when(
        F.col("s.kind") == "assign", F.regexp_extract(F.col("s.value"), BASE[0][1], 2)
    ).otherwise(F.col("s.value"))
    secrets = hits.select(value.alias("token"), F.lit(1).alias("n"))

    share = min(1.0, sample_docs / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit("identifiers"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    words = F.regexp_extract_all(text, F.lit("[A-Za-z_]{2,}"), F.lit(0))
    plain = (
        docs.where(drawn).select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    )
    counts = _transitions(secrets, "random").join(_transitions(plain, "plain"), "pair", "full")
    allowed = [c for c in range(CODES) if chr(c).isalnum() or chr(c) in "+/_.=-"]
    seen = {r["pair"]: (r["random"] or 0, r["plain"] or 0) for r in counts.collect()}  # 128 x 128 at most

    ratios = [0.0] * (CODES * CODES)
    for a in allowed:
        row = [seen.get(a * CODES + b, (0, 0)) for b in allowed]
        random_all, plain_all = sum(x for x, _ in row), sum(y for _, y in row)
        for b, (x, y) in zip(allowed, row, strict=True):
            p = (x + 1) / (random_all + len(allowed))
            q = (y + 1) / (plain_all + len(allowed))
            ratios[a * CODES + b] = round(math.log(p / q), 6)
    return ratios


def random_spans(text: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """Long tokens with a digit that look more like random strings than like identifiers."""
    # One text that the optimizer folds into an array; a literal per number would slow planning.
    model = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")

    def keep(token):
        steps = F.sequence(F.lit(1), F.char_length(token) - 1)
        score = F.aggregate(
            steps,
            F.lit(0.0),
            lambda acc, i: acc
            + F.get(
                model,
                F.ascii(F.substring(token, i, 1)) * CODES + F.ascii(F.substring(token, i + 1, 1)),
            ),
        )
        return (
            token.rlike("[0-9]")
            & (score > F.lit(threshold) * (F.char_length(token) - 1))
        )

    hit = F.coalesce(text, F.lit("")).rlike(CANDIDATE_HINT)
    return F.when(hit, _spans(text, "random", CANDIDATE, keep)).otherwise(_none())


def scanned(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end, value), by start, then kind.

    ``spans`` has the base spans and those that the models add. A token that overlaps a base span
    is not reported again.
    """
    ratios = train(docs) if ratios is None else ratios
    order = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("random"))

    def sorted_spans(spans):
        keyed = F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s.alias("s")
            ),
        )
        return F.transform(F.array_sort(keyed), lambda x: x["s"])

    base = F.col("base")
    added = F.filter(
        random_spans(F.col("text"), ratios, threshold),
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return (
        docs.drop("base", "spans")
        .withColumn("base", sorted_spans(base_spans(F.col("text"))))
        .withColumn("spans", sorted_spans(F.concat(base, added)))
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redacted(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by ``[kind]``; overlapping spans go together."""
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))

    clean = F.aggregate("spans", first, step, finish)
    changed = F.size("spans") > 0
    done = scanned(docs, ratios).withColumn("text", F.when(changed, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        done = done.withColumn(
            "n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    return done.select(*columns)
