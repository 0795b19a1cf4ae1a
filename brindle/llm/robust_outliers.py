"""Quality rules with robust multivariate outliers, in DataFrame expressions only.

Each document gets a vector of transformed statistics. Per language and source, a minimum-covariance-determinant estimate is found by concentration steps (Rousseeuw and Van Driessen, 1999)
from three deterministic starts (as in Hubert, Rousseeuw and Verdonck, 2012). Steps go on until no determinant falls any more, and the start with the least determinant wins. Every distinct
text weighs one, so that copies of one text count once, whatever their number. As in the regularised form (Boudt et al., 2020), scatters are shrunk towards a diagonal target, as far as bounds their
condition number: the target holds the group's own robust variances, which statistics that are constant in a group, such as symbol rates of clean text, do not have to be zero. Documents
beyond a chi-squared limit of the Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut, drop_cut, with_row_key, without

#: The characters that count as symbols, and white space of the word pattern.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: The statistics: name and least deviation that a scatter has. Length alone is no sign of junk, so its least deviation is wide; few symbols and repeats stand in good text too.
STATS = (("log_words", 1.5), ("log_word_length", 0.08), ("root_symbol_rate", 0.08), ("root_dup_line_rate", 0.14), ("root_repeat_rate", 0.14))
#: Words (or lines) of average text that are added to each document's own in the rates, so that few words do not make wide swings, and the word length of the added ones.
PRIOR, PRIOR_LINES, PRIOR_LENGTH = 20, 4, 6
#: Statistics are kept as whole multiples of this, so that sums do not depend on the order of rows.
GRID = 1 / 1024
#: Groups with fewer distinct texts than this use their language's estimate, or the estimate of all rows.
LEAST_GROUP = 60
#: Share of texts in the concentrated subset, bound of the condition number, chi-squared level of the limit, and relative fall of a determinant that counts.
SHARE, CONDITION, LEVEL, FALL = 0.75, 50.0, 0.999, 1e-6
#: Steps of the scale on which distances are ranked, for each doubling; a step that the subset's limit cuts counts in part.
BINS = 64
#: Estimates are repeated under so many salts, so that a source with a third of all rows joins in many tasks.
SALTS = 32


def _chi2_cdf(x: float, k: int) -> float:
    """The regularised lower incomplete gamma function at (k / 2, x / 2), by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z > 0 else 0.0


def _chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: as the argument of a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the runs of `[^\\x20\\x09-\\x0D]+`; empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\x09-\\x0D]+"))


def _window_hashes(words: Column) -> Column:
    """The hashes of the 8-word windows, by their first words: each word is hashed once, then neighbours are combined to two, four and eight words."""

    def doubled(hashes, k):
        return _let(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h) - k), lambda a, b: F.xxhash64(a, b)))

    return doubled(doubled(doubled(F.transform(words, lambda x: F.xxhash64(x)), 1), 2), 4)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, first occurrences included.

    Hashes of the windows only rule out windows without a like; those whose hashes meet are compared themselves, sorted with their positions, and the words that the repeated ones cover are added up.
    """

    def twins(rows, name):
        """Of sorted structs with a position i, those that agree with a neighbour in name."""
        same = lambda s, i, j: F.get(s, i)[name] == F.get(s, j)[name]
        return _let(rows, lambda s: F.filter(s, lambda x, i: ((i > 0) & same(s, i, i - 1)) | ((i < F.size(s) - 1) & same(s, i, i + 1))))

    def total(starts):
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("at")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(8), i - acc["at"])).alias("n"), i.alias("at")),
            lambda acc: acc["n"],
        )

    def exact(w, hashes):
        met = twins(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))), "h")
        pairs = F.array_sort(F.transform(met, lambda x: F.struct(F.array_join(F.slice(w, x["i"], 8), " ").alias("w"), x["i"].alias("i"))))
        return total(F.array_sort(F.transform(twins(pairs, "w"), lambda x: x["i"])))

    def counted(w):
        return _let(_window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(w, h)).otherwise(F.lit(0).cast("long")))

    return _let(words, lambda w: F.when(F.size(w) > 8, counted(w)).otherwise(F.lit(0).cast("long")))


def text_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long), text_hash of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = docs.select(*keep, words_of(F.col(text_col)).alias("_w"), text.alias("_t"))
    counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("kinds")))
    out = out.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", "[ \\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        counts.alias("_l"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.xxhash64("_t").alias("text_hash"),
    )
    return out.select(*keep, "n_words", "word_chars", "n_symbols", (F.col("_l.n") - F.col("_l.kinds")).alias("n_dup_lines"), F.col("_l.n").alias("n_lines"), "n_repeat_words", "text_hash")


def _vector() -> list[Column]:
    n, prior = F.col("n_words") + F.lit(0.0), float(PRIOR)
    values = (
        F.log(F.greatest(n, F.lit(1.0))),
        F.log((F.col("word_chars") + prior * PRIOR_LENGTH) / (n + prior)),
        F.sqrt(F.col("n_symbols") / (n + prior)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + float(PRIOR_LINES))),
        F.sqrt(F.col("n_repeat_words") / (n + prior)),
    )
    return [F.round(v / GRID).cast("long").alias(f"x{k}") for k, v in enumerate(values)]


P = len(STATS)
X = [f"x{k}" for k in range(P)]
#: Share of the target in a scatter: with a trace of P, the condition number against the target then stays below CONDITION.
SHRINK = P / (CONDITION - 1 + P)


def _moments() -> list[Column]:
    """Weighted sums over a group (weights: w), of whole numbers in double precision where weights are whole."""
    x = [F.col(c).cast("double") for c in X]
    w = F.col("w")
    return [F.sum(w).alias("n"), *(F.sum(w * v).alias(f"s{i}") for i, v in enumerate(x)), *(F.sum(w * x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1))]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """The columns of sums that are no sums, with centre m0.., Cholesky factor l0_0.. of the shrunk scatter (factor times the raw one, and the target t0..), and the logarithm of its determinant."""
    g = GRID
    keys = [c for c in sums.columns if c in ("grp", "start", *TARGET)]
    scatter = lambda i, j: (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n"))) * (g * g * factor * (1 - SHRINK))
    return _cholesky(sums.select(*keys, *((F.col(f"s{i}") / F.col("n") * g).alias(f"m{i}") for i in range(P)), *((scatter(i, j) + (F.col(f"t{i}") * SHRINK if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(P) for j in range(i + 1))))


TARGET = [f"t{i}" for i in range(P)]
ESTIMATE = [*(f"m{i}" for i in range(P)), *(f"l{i}_{j}" for j in range(P) for i in range(j, P)), "log_det"]


def _cholesky(frame: DataFrame) -> DataFrame:
    for j in range(P):
        d = F.col(f"c{j}_{j}")
        for k in range(j):
            d = d - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}")
        frame = frame.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(d, F.col(f"t{j}") * (SHRINK / 2))))
        for i in range(j + 1, P):
            v = F.col(f"c{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            frame = frame.withColumn(f"l{i}_{j}", v / F.col(f"l{j}_{j}"))
    log_det = sum((F.log(f"l{j}_{j}") for j in range(1, P)), F.log("l0_0")) * 2
    return frame.withColumn("log_det", log_det).drop(*(f"c{i}_{j}" for i in range(P) for j in range(i + 1)))


def _salted(frame: DataFrame) -> DataFrame:
    return frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _distances(rows: DataFrame, estimates: DataFrame, how: str = "left") -> DataFrame:
    """rows, for each estimate of their group, with d2, the squared Mahalanobis distance to it; and start, if estimates have it."""
    start = [c for c in estimates.columns if c == "start"]
    spread = F.pmod(F.xxhash64(*(c for c in rows.columns if c != "grp")), F.lit(SALTS)).cast("int")  # copies have one vector, but keys of their own
    out = rows.withColumn("_salt", spread).join(_salted(estimates.select("grp", *start, *ESTIMATE)), ["grp", "_salt"], how)
    for i in range(P):
        v = F.col(f"x{i}") * GRID - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}_{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", v / F.col(f"l{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))).select(*rows.columns, *start, "d2")


def _targets(cells: DataFrame) -> DataFrame:
    """grp, medians q0.. and target variances t0..: from quartile ranges of the weighted cells, at least such that their share of a scatter keeps the least deviation. Medians come from bounded tables of values of each group."""
    one = cells.select("grp", "w", F.posexplode(F.array(*X)).alias("i", "x")).groupBy("grp", "i", "x").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("grp", "i")
    upto = one.withColumn("upto", F.sum("w").over(w.orderBy("x"))).withColumn("all", F.sum("w").over(w))
    at = [F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("x"))).alias(f"v{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
    each = upto.groupBy("grp", "i").agg(*at)
    var = lambda i: F.greatest(F.pow((F.col(f"c{i}.v2") - F.col(f"c{i}.v0")) * (GRID / 1.349), 2), F.lit(STATS[i][1] ** 2 / SHRINK))
    wide = each.groupBy("grp").agg(*(F.max(F.when(F.col("i") == i, F.struct("v0", "v1", "v2"))).alias(f"c{i}") for i in range(P)))
    return wide.select("grp", *((F.col(f"c{i}.v1") * GRID).alias(f"q{i}") for i in range(P)), *(var(i).alias(f"t{i}") for i in range(P)))


def _starts(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Three first estimates a group: medians with the target's variances; the same with the correlations of bounded scores, tanh(z); and the moments of the half that is nearest to the medians."""
    zero = lambda t: [F.lit(0.0).alias(f"c{i}_{j}") if i != j else t(i).alias(f"c{i}_{i}") for i in range(P) for j in range(i + 1)]
    centre = [F.col(f"q{i}").alias(f"m{i}") for i in range(P)]
    plain = cut(_cholesky(targets.select("grp", F.lit(0).alias("start"), *TARGET, *centre, *zero(lambda i: F.col(f"t{i}")))))
    near = cut(_distances(cells, plain))
    half = _estimate(_subset(near, 0.5).groupBy("grp").agg(*_moments()).withColumn("start", F.lit(2)).join(targets.select("grp", *TARGET), "grp"), 1.0)
    y = [F.tanh((F.col(f"x{i}") * GRID - F.col(f"q{i}")) / F.sqrt(f"t{i}")) for i in range(P)]
    scored = cells.withColumn("_salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")).join(_salted(targets), ["grp", "_salt"]).select("grp", "w", *(F.round(v * 65536).alias(f"y{i}") for i, v in enumerate(y)))
    sums = scored.groupBy("grp").agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col(f"y{i}")).alias(f"s{i}") for i in range(P)), *(F.sum(F.col("w") * F.col(f"y{i}") * F.col(f"y{j}")).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1))).join(targets, "grp")
    cov = lambda i, j: F.col(f"s{i}_{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n"))
    corr = lambda i, j: F.coalesce(F.try_divide(cov(i, j), F.sqrt(cov(i, i) * cov(j, j))), F.lit(0.0)) * (1 - SHRINK) * F.sqrt(F.col(f"t{i}") * F.col(f"t{j}"))
    bounded = _cholesky(sums.select("grp", F.lit(1).alias("start"), *TARGET, *centre, *((F.col(f"t{i}") if i == j else corr(i, j)).alias(f"c{i}_{j}") for i in range(P) for j in range(i + 1))))
    order = ["grp", "start", *TARGET, *ESTIMATE]
    out = cut(plain.select(order).union(bounded.select(order)).union(half.select(order)))
    drop_cut(plain)
    drop_cut(near)
    return out


def _subset(near: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows with the smallest distances of each group and start, and weights that add up to the share of its weight: by sums over a fine logarithmic scale of distances, whose last step counts in part."""
    binned = near.withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-20) * BINS).cast("int"))
    sums = binned.groupBy("grp", "start", "bin").agg(F.sum("w").alias("k"))
    w = Window.partitionBy("grp", "start")
    upto = sums.withColumn("upto", F.sum("k").over(w.orderBy("bin"))).withColumn("need", F.ceil(F.sum("k").over(w) * share))
    last = upto.filter(F.col("upto") >= F.col("need")).groupBy("grp", "start").agg(F.min(F.struct("bin", ((F.col("need") - F.col("upto") + F.col("k")) / F.col("k")).alias("part"))).alias("last"))
    salted = _salted(last.select("grp", "start", F.col("last.bin").alias("limit"), F.col("last.part").alias("part")))
    kept = binned.withColumn("_salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")).join(salted, ["grp", "start", "_salt"]).filter("bin <= limit")
    return kept.withColumn("w", F.when(F.col("bin") == F.col("limit"), F.col("w") * F.col("part")).otherwise(F.col("w").cast("double")))


def concentrated(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """For each group the estimate with the least determinant that concentration steps reach from the starts, before reweighting."""
    inner = SHARE / _chi2_cdf(_chi2_quantile(SHARE, P), P + 2)
    order = ["grp", "start", *TARGET, *ESTIMATE]
    now = _starts(cells, targets)
    best = None  # the least estimate of each group and start so far, with its determinant as a subset's
    while True:
        near = cut(_distances(cells, now))
        sums = _subset(near).groupBy("grp", "start").agg(*_moments()).join(targets.select("grp", *TARGET), "grp")
        new = cut(_estimate(sums, inner).select(order))
        drop_cut(near)
        drop_cut(now)
        if best is None:
            best = now = new
            now = cut(new)
            continue
        before = best.select("grp", "start", F.col("log_det").alias("before"))
        fallen = cut(new.join(before, ["grp", "start"]).filter(F.col("log_det") < F.col("before") - FALL).select(order))
        drop_cut(new)
        if fallen.isEmpty():
            break
        best = cut(fallen.union(best.join(fallen.select("grp", "start"), ["grp", "start"], "left_anti").select(order)))
        now = fallen
    least = best.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("m")).select("grp", F.col("m.start").alias("start"))
    return cut(best.join(least, ["grp", "start"]).drop("start"))


def covariance_determinant(cells: DataFrame) -> DataFrame:
    """grp, centre and Cholesky factor of the minimum-covariance-determinant estimate of each group of cells (grp, x0.., w: its distinct texts)."""
    targets = cut(_targets(cells))
    now = concentrated(cells, targets)
    # the usual last step: all vectors within the 0.975 quantile, weighted alike
    usual = _chi2_quantile(0.975, P)
    sums = _distances(cells, now).filter(F.col("d2") <= usual).groupBy("grp").agg(*_moments()).join(targets.select("grp", *TARGET), "grp")
    last = cut(_estimate(sums, 0.975 / _chi2_cdf(usual, P + 2)).select("grp", *ESTIMATE))
    out = cut(last.union(now.join(last.select("grp"), "grp", "left_anti").select("grp", *ESTIMATE)))
    for x in (now, targets, last):
        drop_cut(x)
    return out


def _judged(docs: DataFrame, keep: list[Column], text_col: str, lang_col: str, source_col: str, level: float) -> DataFrame:
    """The columns of keep, the statistics, base_failed, kept and distance2 of each row."""
    text = F.col(text_col)
    place = (F.to_json(F.struct(F.col(lang_col).alias("l"))).alias("lang"), F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s"))).alias("pair"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = docs.select(F.struct(*keep).alias("own"), text.alias("text"), *place)
    rows = cut(text_statistics(rows, ["own", "lang", "pair"]).withColumn("base_failed", base).select("*", *_vector()))
    texts = rows.filter("not base_failed").groupBy("lang", "pair", *X, "text_hash").agg(F.lit(1).alias("w"))
    cells = cut(texts.groupBy("lang", "pair", *X).agg(F.sum("w").alias("w")))
    pairs = cells.groupBy("lang", "pair").agg(F.sum("w").alias("k"))
    langs = pairs.filter(F.col("k") < LEAST_GROUP).groupBy("lang").agg(F.sum("k").alias("kl"))
    groups = cut(pairs.join(langs, "lang", "left").select("pair", F.when(F.col("k") >= LEAST_GROUP, F.col("pair")).when(F.col("kl") >= LEAST_GROUP, F.col("lang")).otherwise(F.lit("")).alias("grp")))
    salt = F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")
    assigned = cut(cells.withColumn("_salt", salt).join(_salted(groups), ["pair", "_salt"]).groupBy("grp", *X).agg(F.sum("w").alias("w")))
    estimates = covariance_determinant(assigned)
    spread = F.pmod(F.xxhash64("own", *X), F.lit(SALTS)).cast("int")  # copies of one text have one vector, but ids of their own
    found = rows.withColumn("_salt", spread).join(_salted(groups), ["pair", "_salt"], "left").drop("_salt", "pair", "lang", "text_hash")
    limit = F.coalesce(F.col("d2") <= _chi2_quantile(level, P), F.lit(True))
    out = _distances(found, estimates).withColumn("kept", ~F.col("base_failed") & limit).withColumn("distance2", F.when(~F.col("base_failed"), F.col("d2")))
    return out.select("own.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def robust_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", level: float = LEVEL) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the squared distance.

    Words are `[^\\x20\\x09-\\x0D]+`; null text has none. base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept is
    false for these and for documents beyond the limit; distance2 is null for them. Null languages and sources form groups of their own. A group with few distinct
    texts (LEAST_GROUP) uses its language's rows that are alike short of data, or all such rows. Repeated rows each give a row; an empty table gives none.
    """
    return _judged(docs, [F.col(id_col).alias("doc_id")], text_col, lang_col, source_col, level)


def keep_regular(docs: DataFrame) -> DataFrame:
    """docs without the rows that robust_outliers rejects; columns as they came. Each row is judged by itself, whatever its id."""
    keyed, name = with_row_key(docs)
    return without(keyed, name, _judged(keyed, [F.col(name)], "text", "lang", "source", LEVEL).filter("not kept").select(name))
