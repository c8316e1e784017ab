"""Quality rules: base statistics and robust multivariate outliers.

Every document has five statistics on a logarithmic scale. For each language
and source the minimum covariance determinant estimate gives the centre and
scatter of the bulk. A document is rejected if its squared Mahalanobis
distance exceeds ``CUTOFF``.

Estimate: three deterministic starts (median deviations alone; correlations
of tanh-squashed and of sign-projected statistics) take concentration steps,
each of which refits mean and scatter on the ``CORE`` share of documents of
least distance. After ``FIRST_STEPS`` the start of least determinant goes on
until no determinant falls any more. A fixed diagonal (``FLOORS``, the least
variance of each statistic) is part of every scatter, as in the regularised
estimator, so steps still never raise the determinant and groups of any size
have one. Scatter is made consistent with a normal bulk (``consistency``).

Small groups: every pair's estimate is shrunk towards that of its language,
this towards that of all documents, by ``PRIOR`` documents for the scatter
and ``PRIOR_MEAN`` for the centre; nothing switches with the size. All three
levels are fitted on all their documents.

Main path: DataFrame functions only. Statistics are whole numbers of
``GRID`` parts, so all sums are exact and results don't depend on the order
of rows. Each step is one aggregation by group and distance bin, combined
before the exchange and dealt by (group, bin), so a group with a third of all
rows is no single task's; a group has at most some thousand bins. Estimates,
one row for each group, go back by a join that is broadcast if their number
is small (``FEW``). Texts are never shuffled.

Edge cases: null texts are empty; null languages and sources are groups of
their own, apart from the empty string; repeated rows count each and are
judged each. Columns other than doc_id, text, lang and source are ignored
but for those named in ``pass_through``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.llm.storage import materialise

MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated five-word windows
CORE = 0.75
FIRST_STEPS = 2
SETTLED = 1e-3  # fall of the logarithm of a determinant
PRIOR, PRIOR_MEAN = 100, 20  # so that two copies of junk in a group of their own still are far from the others
FEW = 10_000  # pairs of language and source; three estimates of each take some 15 MB
GRID = 1000
#: Least standard deviation of each statistic, in natural-log units.
FLOORS = (0.5, 0.1, 0.25, 0.5, 1.0)
_DIMS = len(FLOORS)
_SPACES = " \t\n\x0b\x0c\r"
_STARTS = ("deviations", "tanh", "signs")
_LOWER = [(i, j) for i in range(_DIMS) for j in range(i + 1)]


def chi_square(x: float, dims: int) -> float:
    """Distribution function for an odd number of degrees of freedom."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, dims, 2):
        total -= term
        term *= x / (k + 2)
    return total


def chi_square_quantile(share: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < share else (low, mid)
    return low


def consistency(core: float = CORE) -> float:
    """What makes the scatter of the core of a normal bulk that of the bulk."""
    return core / chi_square(chi_square_quantile(core, _DIMS), _DIMS + 2)


#: Share of the documents of a normal bulk that may be rejected, and its
#: quantile. Tails of real statistics are longer than normal ones, so the
#: usual 0.975 would drop clean documents.
FALSE_ALARMS = 1e-5
CUTOFF = chi_square_quantile(1 - FALSE_ALARMS, _DIMS)


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in five-word windows that are found twice or more."""

    def of_words(w: Column) -> Column:
        at = lambda i, k: F.get(w, i + k)
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(at(i, k) for k in range(5))))
        return F.when(F.size(w) < 5, F.lit(0)).otherwise(_bind(windows, of_windows))

    def of_windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        hash_at = lambda k: F.get(s, k)["h"]
        twice = F.filter(s, lambda x, k: F.coalesce(x["h"] == hash_at(k - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(k + 1), F.lit(False)))
        return _bind(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)

    return _bind(words, of_words)


def base_statistics(docs: DataFrame, pass_through: tuple[str, ...] = ()) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, _SPACES, "")
    words = F.filter(F.split(F.translate(text, _SPACES[1:], " " * 5), " "), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    lang, source = (F.col(c).cast("string").alias(c) for c in ("lang", "source"))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat(F.lit("1"), F.to_json(F.struct(lang))).alias("g1"),
        F.concat(F.lit("2"), F.to_json(F.struct(lang, source))).alias("g2"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("repeated"))).alias("w"),
        F.struct(*pass_through, F.lit(0).alias("_")).alias("passed"),
    )
    out = out.withColumn("n_words", F.col("w.n")).withColumn("n_repeat_words", F.col("w.repeated")).drop("w")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    """The statistics, in parts of ``GRID`` of a natural-log unit."""
    n = F.col("n_words") + 1
    raw = [
        F.log(n.cast("double")),
        F.log((F.col("word_chars") + 1) / n),
        F.log1p(100 * F.col("n_symbols") / (F.col("word_chars") + 1)),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(100 * F.col("n_repeat_words") / n),
    ]
    return [F.round(x * GRID).cast("long") for x in raw]


def _dims(body) -> list[Column]:
    return [body(i) for i in range(_DIMS)]


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _medians(values: DataFrame, name: str) -> DataFrame:
    """``grp`` and the lower median ``name``0.. of each statistic x0.., by counts of grid values."""
    each = values.select("grp", F.posexplode(F.array(*_dims(lambda i: F.col(f"x{i}")))).alias("dim", "x"))
    counts = each.groupBy("grp", "dim", "x").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("grp", "dim")
    below = F.sum("n").over(one.orderBy("x")) * 2 >= F.sum("n").over(one)
    middle = counts.withColumn("at", F.when(below, F.col("x"))).groupBy("grp", "dim").agg(F.min("at").alias("x"))
    out = middle.groupBy("grp").agg(*_dims(lambda i: F.max(F.when(F.col("dim") == i, F.col("x"))).alias(f"{name}{i}")))
    return materialise(out, "medians")


def _whitened(scatter: DataFrame, *keys: str) -> DataFrame:
    """From m0.. and c00.. the rows of an inverse Cholesky factor (w00..) and log_det."""
    made = {}
    for i, j in _LOWER:
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))  # noqa: B023
        made[f"l{i}{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}")
    for i, j in _LOWER:
        inner = [F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)]  # noqa: B023
        made[f"w{i}{j}"] = F.lit(1.0) / F.col(f"l{i}{i}") if i == j else -_sum(inner) / F.col(f"l{i}{i}")
    made["log_det"] = 2 * _sum(_dims(lambda i: F.log(f"l{i}{i}")))
    df = scatter.select("*", *(v.alias(c) for c, v in made.items()))  # later ones use earlier ones by name
    return df.select(*keys, *_dims(lambda i: F.col(f"m{i}")), *(f"w{i}{j}" for i, j in _LOWER), "log_det")


def _distance() -> Column:
    """Squared distance of x0.. under m0.. and w00.."""
    y = lambda i: _sum(F.col(f"w{i}{k}") * (F.col(f"x{k}") - F.col(f"m{k}")) for k in range(i + 1))
    return _sum(F.pow(y(i), F.lit(2.0)) for i in range(_DIMS))


def _moments() -> list[Column]:
    """Exact sums over rows: n, s0.., q00.."""
    return [
        F.count(F.lit(1)).alias("n"),
        *_dims(lambda i: F.sum(f"x{i}").alias(f"s{i}")),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _LOWER),
    ]


def _totals() -> list[Column]:
    """Sums of ``_moments``, wide enough for any number of rows."""
    names = ["n", *_dims(lambda i: f"s{i}"), *(f"q{i}{j}" for i, j in _LOWER)]
    return [F.sum(F.col(c).cast("decimal(28,0)")).cast("double").alias(c) for c in names]


def _scatter(sums: DataFrame, *keys: str) -> DataFrame:
    """n, mean and consistent scatter (c00.., with the fixed diagonal) from sums."""
    factor = consistency()
    mean = _dims(lambda i: F.col(f"s{i}") / F.col("n"))
    spread = lambda i, j: factor * (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j])
    floor = lambda i, j: (FLOORS[i] * GRID) ** 2 if i == j else 0.0
    return sums.select(*keys, "n", *_dims(lambda i: mean[i].alias(f"m{i}")), *((spread(i, j) + floor(i, j)).alias(f"c{i}{j}") for i, j in _LOWER))


def _bin(d2: Column) -> Column:
    """Distance as a bin of a logarithmic scale of bounded length."""
    return F.least(F.floor(F.log1p(d2) * 400), F.lit(20_000)).cast("int")


def _step(rows: DataFrame, estimate: DataFrame, side) -> DataFrame:
    """One concentration step: scatter of the ``CORE`` share of each group and start."""
    bins = rows.join(side(estimate), "grp").withColumn("bin", _bin(_distance())).groupBy("grp", "start", "bin").agg(*_moments())
    one = Window.partitionBy("grp", "start")
    before = F.coalesce(F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = bins.withColumn("before", before).withColumn("of", F.sum("n").over(one)).filter(F.col("before") < F.col("of") * CORE)
    return _scatter(core.groupBy("grp", "start").agg(*_totals()), "grp", "start")


def _starts(rows: DataFrame, side) -> DataFrame:
    """First centre and scatter of each group, by three ways."""
    middle = _medians(rows, "m")
    off = rows.join(side(middle), "grp")
    spread = _medians(off.select("grp", *_dims(lambda i: F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}"))), "a")
    scale = _dims(lambda i: F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, F.lit(2.0)) + (FLOORS[i] * GRID) ** 2))
    known = middle.join(spread, "grp").select("grp", *_dims(lambda i: F.col(f"m{i}")), *_dims(lambda i: scale[i].alias(f"a{i}")))
    known = materialise(known, "scales")
    z = _dims(lambda i: (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"a{i}"))
    length = F.sqrt(_sum(F.pow(c, F.lit(2.0)) for c in z))
    whole = lambda c: F.round(c * GRID).cast("long")
    squashed = F.array(*(whole(F.tanh(c)) for c in z))
    signs = F.array(*(whole(F.when(length > 0, c / length).otherwise(0.0)) for c in z))
    kinds = F.array(F.struct(F.lit(1).alias("start"), squashed.alias("v")), F.struct(F.lit(2).alias("start"), signs.alias("v")))
    each = rows.join(side(known), "grp").select("grp", F.explode(kinds).alias("e")).select("grp", "e.start", *_dims(lambda i: F.col("e.v")[i].alias(f"x{i}")))
    sums = each.groupBy("grp", "start").agg(*_moments()).groupBy("grp", "start").agg(*_totals())
    cov = lambda i, j: F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.pow("n", F.lit(2.0))
    # a correlation from squashed values, drawn to the diagonal so that it can be inverted
    root = lambda i: F.sqrt(F.greatest(cov(i, i), F.lit(1.0)))
    corr = sums.select("grp", "start", *((F.lit(1.0) if i == j else 0.9 * cov(i, j) / (root(i) * root(j))).alias(f"r{i}{j}") for i, j in _LOWER))
    plain = known.select("grp", F.lit(0).alias("start"), *((F.lit(1.0) if i == j else F.lit(0.0)).alias(f"r{i}{j}") for i, j in _LOWER))
    both = plain.unionByName(corr).join(known, "grp")
    return both.select("grp", "start", *_dims(lambda i: F.col(f"m{i}")), *((F.col(f"r{i}{j}") * F.col(f"a{i}") * F.col(f"a{j}")).alias(f"c{i}{j}") for i, j in _LOWER))


def robust_estimates(rows: DataFrame, side) -> DataFrame:
    """MCD estimate of each ``grp`` of ``rows`` (x0..): n of the core, m0.., c00..

    ``side`` makes a table with a row for each group a side of a join.
    What has one row for each group is written after each step; of it, only
    the number of determinants that still fall comes to the driver.
    """
    found = materialise(_starts(rows, side), "starts")
    for _ in range(FIRST_STEPS):
        found = materialise(_step(rows, _whitened(found, "grp", "start"), side), "step")
    ranked = _whitened(found, "grp", "start").withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("log_det", "start")))
    best = found.join(ranked.filter("place = 1").select("grp", "start", F.col("log_det").alias("known")), ["grp", "start"])
    best = materialise(best.drop("start"), "best")
    while True:
        tried = _step(rows, _whitened(best.withColumn("start", F.lit(0)), "grp", "start"), side).drop("start")
        dets = _whitened(tried, "grp").select("grp", F.col("log_det").alias("now"))
        tried = materialise(tried.join(dets, "grp").join(best.select("grp", "known"), "grp"), "step")
        falls = F.col("now") < F.col("known") - SETTLED
        if not tried.filter(falls).count():
            return best.drop("known")
        # a group whose determinant rises (ties of a bin) or stays keeps what it has
        kept = best.join(tried.filter(~falls).select("grp"), "grp", "left_semi")
        best = materialise(tried.filter(falls).drop("known").withColumnRenamed("now", "known").unionByName(kept), "best")


def _shrunk(estimate: DataFrame, parents: DataFrame) -> DataFrame:
    """Every pair's estimate, shrunk to its language's, and that to all documents'.

    ``parents`` has g1, g2 of every row that may be judged.
    """
    over = lambda level: estimate.select(*(F.col(c).alias(c if c == "grp" else f"{c}_{level}") for c in estimate.columns))
    df = parents.join(over(2), F.col("g2") == F.col("grp"), "left").drop("grp")
    df = df.join(over(1), F.col("g1") == F.col("grp")).drop("grp").crossJoin(F.broadcast(over(0).filter("grp = '0'").drop("grp")))  # one row
    names = _dims(lambda i: f"m{i}") + [f"c{i}{j}" for i, j in _LOWER]

    def blend(own: str, parent: Column, level: int, prior: int) -> Column:
        n = F.coalesce(F.col(f"n_{level}"), F.lit(0.0))
        return (n * F.coalesce(F.col(f"{own}_{level}"), F.lit(0.0)) + prior * parent) / (n + prior)

    out = {}
    for c in names:
        prior = PRIOR_MEAN if c[0] == "m" else PRIOR
        out[c] = blend(c, blend(c, F.col(f"{c}_0"), 1, prior), 2, prior)
    return df.select("g2", *(v.alias(c) for c, v in out.items()))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, pass_through: tuple[str, ...] = ()) -> DataFrame:
    """Judge whole texts. One row for each row of ``docs``.

    Returns doc_id, the base statistics, base_failed, d2 (squared robust
    distance; null if base_failed), kept and ``passed``, a struct of the
    columns named in ``pass_through`` as they were.
    """
    stats = base_statistics(docs, pass_through)
    for i, x in enumerate(_vector()):
        stats = stats.withColumn(f"x{i}", x)
    stats = materialise(stats, "statistics")
    fitted = stats.filter(~F.col("base_failed"))
    xs = _dims(lambda i: F.col(f"x{i}"))
    rows = fitted.select(F.explode(F.array("g1", "g2", F.lit("0"))).alias("grp"), *xs)
    parents = materialise(fitted.select("g1", "g2").distinct(), "groups")
    side = F.broadcast if parents.count() <= FEW else lambda df: df
    estimate = materialise(_whitened(_shrunk(robust_estimates(rows, side), parents), "g2").drop("log_det"), "estimate")
    out = stats.join(side(estimate), "g2", "left").withColumn("d2", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", kept.alias("kept"), "passed")
