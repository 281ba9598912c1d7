"""Quality rules: base statistics and robust multivariate outliers per language and source, with DataFrame functions only.

The statistics of a text are transformed to a vector of four numbers. For each language and source the
minimum-covariance-determinant estimate is found by concentration steps: from each of three starts (median
and median absolute deviation, shortest halves, covariance of bounded scores) a step takes the half of the
rows with the least Mahalanobis distances and estimates mean and covariance anew, until no determinant
changes. The start with the least determinant wins, and the rows near it give the last estimate. Rows beyond
CUTOFF of it are rejected.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.shared import materialize

#: Fewer words fail; more than this percentage of words in repeated windows fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Number of starts, steps at most, change of a determinant's logarithm that counts as one, and rows a group needs for an estimate of its own.
STARTS, STEPS, CHANGE, LEAST_ROWS = 3, 12, 0.01, 200
#: Squared Mahalanobis distance: the 1 - 1e-5 quantile of chi-square with four degrees of freedom.
CUTOFF = 28.5
#: Least standard deviation by coordinate: a clean group may have none at all in some.
FLOORS = (0.06, 0.15, 0.15, 0.15)
#: The covariance of the central half of four normal coordinates underestimates by 0.5 / P(chi-square(6) < its median at 4).
CONSISTENCY = 2.109
#: Rows up to the 0.975 quantile of chi-square give the last estimate, and the factor for what it underestimates.
NEAR, NEAR_CONSISTENCY = 11.143, 1.0645
DIM = 4
P = "__qr_"  # of working columns
GROUP, START = P + "group", P + "start"


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__qr_`` columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long."""
    blank = r"[\x20\x09-\x0D]+"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(P + "text", text)
    out = out.withColumn(P + "words", F.array_remove(F.split(P + "text", blank), ""))
    out = out.withColumn(P + "lines", F.filter(F.split(P + "text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    plain = F.col(P + "text")
    for mark in "#*$%&|<>":
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    out = out.withColumns({
        P + "n_words": F.size(P + "words").cast("long"),
        P + "word_chars": F.length(F.array_join(P + "words", "")).cast("long"),
        P + "n_symbols": (F.octet_length(P + "text") - F.octet_length(plain)).cast("long"),
        P + "n_dup_lines": (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long"),
        P + "h": F.transform(P + "words", lambda w: F.xxhash64(w)),
    })
    n = F.size(P + "h")
    # three columns deep, so that no step is worked out again for each element of another
    out = out.withColumn(P + "zip", F.when(n >= 3, F.slice(F.arrays_zip(F.col(P + "h").alias("a"), F.slice(P + "h", 2, n).alias("b"), F.slice(P + "h", 3, n).alias("c")), 1, n - 2)))
    out = out.withColumn(P + "win", F.transform(P + "zip", lambda x: F.xxhash64(x)))
    m = F.size(P + "win")
    some = m > F.size(F.array_distinct(P + "win"))
    out = out.withColumn(P + "sorted", F.when(some, F.sort_array(F.transform(P + "win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(P + "sorted")
    nothing = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i")))
    out = out.withColumn(P + "around", F.arrays_zip(s.alias("at"), F.concat(nothing, s).alias("before"), F.slice(s, 2, m).alias("after")))
    out = out.withColumn(P + "hits", F.sort_array(F.transform(
        F.filter(P + "around", lambda x: F.coalesce(x["before"]["h"] == x["at"]["h"], F.lit(False)) | F.coalesce(x["after"]["h"] == x["at"]["h"], F.lit(False))), lambda x: x["at"]["i"])))
    hits = F.col(P + "hits")
    out = out.withColumn(P + "gaps", F.arrays_zip(hits.alias("p"), F.slice(hits, 2, F.size(hits)).alias("q")))
    covered = F.aggregate(P + "gaps", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.least(x["q"] - x["p"], F.lit(3)), F.lit(3)).cast("long"))
    out = out.withColumn(P + "n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return out.drop(*[P + c for c in ("text", "words", "lines", "h", "zip", "win", "sorted", "around", "hits", "gaps")])


def base_failed() -> Column:
    return (F.col(P + "n_words") < LEAST_WORDS) | (100 * F.col(P + "n_repeat_words") > MOST_REPEATED * F.col(P + "n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics: roots and logarithms bring the shares near a normal shape."""
    n = F.greatest(F.col(P + "n_words"), F.lit(1)).cast("double")
    return {P + "x0": F.log(F.greatest(F.col(P + "word_chars"), F.lit(1)) / n), P + "x1": F.sqrt(F.col(P + "n_symbols") / n) * 2,
            P + "x2": F.sqrt(F.col(P + "n_dup_lines") / n) * 2, P + "x3": F.sqrt(F.col(P + "n_repeat_words") / n)}


def source_key() -> tuple[Column, Column]:
    lang, source = F.coalesce(F.col(P + "lang"), F.lit("\x00")), F.coalesce(F.col(P + "source"), F.lit("\x00"))
    return F.concat_ws("\x01", F.lit("source"), lang, source), F.concat_ws("\x01", F.lit("language"), lang)


def groups(rows: DataFrame) -> DataFrame:
    """``__qr_own, __qr_group`` of each language and source: itself, the language if it has under LEAST_ROWS rows there, or all small languages together."""
    own, wide = source_key()
    fit = rows.filter(~F.col(P + "failed"))
    counts = fit.groupBy(own.alias(P + "own"), wide.alias(P + "wide")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("large", F.col("n") >= LEAST_ROWS)
    rest = F.sum(F.when(~F.col("large"), F.col("n")).otherwise(0)).over(Window.partitionBy(P + "wide"))
    return counts.select(P + "own", F.when(F.col("large"), F.col(P + "own")).when(rest >= LEAST_ROWS, F.col(P + "wide")).otherwise("all").alias(P + "group"))


def grouped(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    return rows.withColumn(P + "own", source_key()[0]).join(chosen, P + "own", "left").drop(P + "own")


PAIRS = [(a, b) for a in range(DIM) for b in range(a + 1)]


def moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """By key: mean and the lower triangle of the covariance's Cholesky factor, all columns. ``__qr_det`` of ``rows`` becomes ``before``."""
    x = [F.col(f"{P}x{k}") for k in range(DIM)]
    sums = rows.groupBy(*keys).agg(*[F.avg(x[k]).alias(f"m{k}") for k in range(DIM)], *[F.covar_pop(x[a], x[b]).alias(f"c{a}{b}") for a, b in PAIRS], F.first(P + "det").alias("before"))
    return factored(sums, keys, scale)


def factored(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    for a, b in PAIRS:
        v = F.col(f"c{a}{b}") * scale
        if a == b:
            v = F.greatest(v, F.lit(FLOORS[a] ** 2))
        for k in range(b):
            v = v - F.col(f"l{a}{k}") * F.col(f"l{b}{k}")
        # the floor also bounds what is left of a variance that other coordinates explain
        sums = sums.withColumn(f"l{a}{b}", F.sqrt(F.greatest(v, F.lit(FLOORS[a] ** 2 / 4))) if a == b else v / F.col(f"l{b}{b}"))
    det = 2 * sum((F.log(f"l{k}{k}") for k in range(1, DIM)), F.log("l00"))
    return sums.select(*keys, *[f"m{k}" for k in range(DIM)], *[f"l{a}{b}" for a, b in PAIRS], det.alias(P + "det"), "before")


def distances(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``__qr_d2``, the squared Mahalanobis distance by forward substitution, and the estimate's ``__qr_det``."""
    out = rows.join(estimate, keys, "left")
    y: list[Column] = []
    for a in range(DIM):
        v = F.col(f"{P}x{a}") - F.col(f"m{a}")
        for k in range(a):
            v = v - F.col(f"l{a}{k}") * y[k]
        out = out.withColumn(f"{P}y{a}", v / F.col(f"l{a}{a}"))
        y.append(F.col(f"{P}y{a}"))
    d2 = sum((v * v for v in y[1:]), y[0] * y[0])
    return out.withColumn(P + "d2", d2).drop(*[f"{P}y{a}" for a in range(DIM)], *[c for c in estimate.columns if c not in (*keys, P + "det")])


def central(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The half, (n + DIM + 1) / 2, of each key's rows with the least distances, to a bin of 1 / 32 of the logarithm: counts of bins, no sort of a group."""
    b = F.floor(F.log1p(P + "d2") * 32).cast("int")
    counts = rows.groupBy(*keys, b.alias(P + "bin")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys).orderBy(P + "bin")
    limits = (counts.withColumn("before", F.sum("n").over(up) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
              .filter(2 * F.col("before") < F.col("all") + DIM + 1).groupBy(*keys).agg(F.max(P + "bin").alias(P + "limit")))
    return rows.withColumn(P + "bin", b).join(limits, keys).filter(F.col(P + "bin") <= F.col(P + "limit")).drop(P + "bin", P + "limit")


def starts(fit: DataFrame) -> DataFrame:
    """By group and start, a first estimate: medians and median absolute deviations, shortest halves, covariance of bounded scores."""
    x = [F.col(f"{P}x{k}") for k in range(DIM)]
    q = fit.groupBy(GROUP).agg(*[F.percentile_approx(x[k], [i / 20 for i in range(21)], 10000).alias(f"q{k}") for k in range(DIM)])
    q = q.select("*", *[F.col(f"q{k}")[10].alias(f"m{k}") for k in range(DIM)])
    mad = fit.join(q, GROUP).groupBy(GROUP).agg(*[F.first(c).alias(c) for k in range(DIM) for c in (f"m{k}", f"q{k}")],
                                                *[(1.4826 * F.percentile_approx(F.abs(x[k] - F.col(f"m{k}")), 0.5, 10000)).alias(f"s{k}") for k in range(DIM)])
    mad = materialize(mad, "rules-starts")
    alone = [F.lit(0.0).alias(f"c{a}{b}") for a, b in PAIRS if a != b]
    first = mad.select(GROUP, F.lit(0).alias(START), *[f"m{k}" for k in range(DIM)], *alone, *[F.pow(f"s{k}", F.lit(2)).alias(f"c{k}{k}") for k in range(DIM)])
    halves = mad.select(GROUP, *[f"q{k}" for k in range(DIM)], *[F.array_min(F.array(*[F.struct((F.col(f"q{k}")[i + 10] - F.col(f"q{k}")[i]).alias("w"), F.lit(i).alias("i")) for i in range(11)])).alias(f"h{k}") for k in range(DIM)])
    second = halves.select(GROUP, F.lit(1).alias(START), *[F.col(f"q{k}")[F.col(f"h{k}.i") + 5].alias(f"m{k}") for k in range(DIM)], *alone, *[F.pow(F.col(f"h{k}.w") / 1.349, F.lit(2)).alias(f"c{k}{k}") for k in range(DIM)])
    s = [F.greatest(F.col(f"s{k}"), F.lit(FLOORS[k])) for k in range(DIM)]
    scores = fit.join(mad, GROUP).select(GROUP, *[f"m{k}" for k in range(DIM)], *[s[k].alias(f"s{k}") for k in range(DIM)], *[F.tanh((x[k] - F.col(f"m{k}")) / s[k]).alias(f"t{k}") for k in range(DIM)])
    # 0.394 is the variance of the hyperbolic tangent of a normal number
    third = scores.groupBy(GROUP).agg(*[(F.first(f"m{k}") + F.first(f"s{k}") * F.avg(f"t{k}")).alias(f"m{k}") for k in range(DIM)],
                                      *[(F.covar_pop(f"t{a}", f"t{b}") * F.first(f"s{a}") * F.first(f"s{b}") / 0.394).alias(f"c{a}{b}") for a, b in PAIRS]).withColumn(START, F.lit(2))
    return factored(first.unionByName(second).unionByName(third).withColumn("before", F.lit(0.0)), [GROUP, START], 1.0)


def estimates(fit: DataFrame) -> DataFrame:
    """By group, the minimum-covariance-determinant mean and Cholesky factor. ``fit``: the group and vector of rows that passed the base rules."""
    keys = [GROUP, START]
    each = fit.withColumn(START, F.explode(F.array(*[F.lit(k) for k in range(STARTS)])))
    now = materialize(starts(fit), "rules-estimate")
    for _ in range(STEPS):
        now = materialize(moments(central(distances(each, now, keys), keys), keys, CONSISTENCY), "rules-estimate")
        if (now.agg(F.max(F.abs(F.col(P + "det") - F.col("before")))).first()[0] or 0) < CHANGE:
            break
    least = now.groupBy(GROUP).agg(F.min_by(F.struct(*[c for c in now.columns if c not in keys]), F.struct(P + "det", START)).alias("e")).select(GROUP, "e.*")
    near = distances(fit, least, [GROUP]).filter(F.col(P + "d2") <= NEAR)
    return materialize(moments(near, [GROUP], NEAR_CONSISTENCY), "rules-estimate")


def judged(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and the ``__qr_`` columns with ``__qr_failed`` and ``__qr_kept``, from a written table."""
    extra = {P + c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")) for c in ("lang", "source")}
    rows = base_columns(docs.withColumns(extra).select(*columns, P + "lang", P + "source", *([] if "text" in columns else ["text"])))
    # texts are written once, with their statistics; the groups are a small table, and the estimate reads narrow rows
    rows = materialize((rows if "text" in columns else rows.drop("text")).withColumns(vector()).withColumn(P + "failed", base_failed()), "rules-statistics")
    rows = grouped(rows, materialize(groups(rows), "rules-groups"))
    fit = materialize(rows.filter(~F.col(P + "failed")).select(GROUP, *[f"{P}x{k}" for k in range(DIM)]), "rules-fit")
    far = distances(rows, estimates(fit), [GROUP])
    return far.withColumn(P + "kept", ~F.col(P + "failed") & F.coalesce(F.col(P + "d2") <= CUTOFF, F.lit(True)))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2, group``.

    One row per row of ``docs``, repeated rows too. A null or empty text has no words and fails. A missing
    or null language or source is a value of its own. Groups under LEAST_ROWS share their language's
    estimate, and languages under it share one. Two windows are equal if their 64-bit hashes are. Extra
    columns are ignored; an empty table gives an empty result.
    """
    out = judged(docs, ["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(P + c).alias(c) for c in names], F.col(P + "failed").alias("base_failed"), F.col(P + "kept").alias("kept"), F.col(P + "d2").alias("distance2"), F.col(P + "group").alias("group"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and aren't outliers."""
    return judged(docs, docs.columns).filter(P + "kept").select(*docs.columns)
