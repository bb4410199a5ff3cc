"""Secret scans: patterns plus a randomness test battery, in DataFrame functions only.

Base spans come from three patterns. The method adds runs of 20 or more key characters that
look drawn at random from an encoding's alphabet (hexadecimal, base32 or base64, inferred
from the characters). Three tests look for structure: chi-squared uniformity over the
alphabet, runs above and below its middle, and the serial correlation of neighbours; Fisher's
method combines them, and a run with p below NOT_RANDOM is ordinary text.

Short runs pass such tests too easily. So each run also gets the probability that prose would
look so unlike prose: by Markov's inequality, at most the likelihood of the run under a
letter model of prose over its likelihood under the uniform alphabet, which falls with its
length. The Benjamini-Hochberg step over all runs of all documents keeps the expected share
of false discoveries under FALSE_DISCOVERIES; it needs only a histogram of the logarithms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import NULL_ID, given_id, saved

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: runs of key characters; one without a digit or two capitals is prose by the letter model
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
MIXED = r"[0-9]|[A-Z][^A-Z]*[A-Z]"
NOT_RANDOM = 1e-3
FALSE_DISCOVERIES = 0.01
#: bins of the histogram: natural logarithms of probabilities down to -LOGS, BINS each unit
LOGS, BINS = 60, 8

# Per cent of the letters a to z in English text.
LETTERS = (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4,
    6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074,
)
_BLOCK = 256


def _prose(capitals: bool) -> list[float]:
    """ln of the chance of each ASCII character in prose, or in prose written in capitals."""
    main, other = (0.9, 0.05)
    out = [math.log(0.02 / 5)] * 128
    for k, share in enumerate(LETTERS):
        share /= sum(LETTERS)
        out[97 + k] = math.log(share * (other if capitals else main))
        out[65 + k] = math.log(share * main if capitals else other / 26)
    for k in range(48, 58):
        out[k] = math.log(0.03 / 10)
    return out


def _spans(text: str, pattern: str, kind: int, keep: str = "true", begin: str = "") -> str:
    """SQL: array of (start, kind, end) of the matches in column ``text`` that satisfy ``keep``
    (over the match ``m`` and its second group ``g``). Starts are running sums of the gaps and
    matches, in blocks so that many matches cost little more than a few."""
    pattern = pattern.replace("\\", "\\\\").replace("'", "\\'")
    # each level binds what the next one uses, so nothing is computed twice
    group = f"regexp_extract_all({text}, '{pattern}', 2)" if begin else "cast(array() as array<string>)"
    matches = (
        f"transform(array(struct(split({text}, '{pattern}', -1) as gap, "
        f"regexp_extract_all({text}, '{pattern}', 0) as m, {group} as g)), s -> "
        f"transform(s.m, (x, i) -> struct(cast(length(s.gap[i]) as long) as gap, cast(length(x) as long) as n, "
        f"x as m, get(s.g, i) as g)))[0]"
    )
    running = (
        "aggregate({}, struct(cast({} as long) as at, cast(array() as array<struct<a:bigint,b:bigint,m:string,g:string>>) as out), "
        "(acc, x) -> struct(acc.at + x.gap + x.n as at, concat(acc.out, array(struct(acc.at + x.gap as a, "
        "acc.at + x.gap + x.n as b, x.m as m, x.g as g))) as out))"
    )
    blocks = (
        f"transform(array({matches}), all -> transform(sequence(0, greatest(size(all) - 1, 0) div {_BLOCK}), "
        f"k -> {running.format(f'slice(all, k * {_BLOCK} + 1, {_BLOCK})', '0L')}))[0]"
    )
    joined = (
        f"aggregate({blocks}, struct(0L as at, cast(array() as array<array<struct<a:bigint,b:bigint,m:string,g:string>>>) as out), "
        "(acc, x) -> struct(acc.at + x.at as at, concat(acc.out, array(transform(x.out, y -> "
        "struct(acc.at + y.a as a, acc.at + y.b as b, y.m as m, y.g as g)))) as out), acc -> flatten(acc.out))"
    )
    return f"filter({joined}, s -> {keep.format(m='s.m', g='s.g')})"


def _struct(spans: str, kind: int) -> str:
    return f"transform({spans}, s -> struct(s.a as start, {kind} as kind, s.b as end))"


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) of a normal variable (Abramowitz and Stegun 26.2.17)."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(2 * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly, F.lit(1e-300))


def _battery(runs: DataFrame) -> DataFrame:
    """For rows with ``token``: log_p of the discovery and p of randomness; others (no
    encoding fits) are left out."""
    rows = runs.withColumn(
        "_alphabet",
        F.when(F.col("token").rlike("^[0-9_=-]+$"), None)
        .when(F.col("token").rlike("^([0-9a-f]+|[0-9A-F]+)$"), "0123456789abcdef")
        .when(F.col("token").rlike("^[A-Z2-7]+=*$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        .otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ).filter("_alphabet is not null")
    # the padding of an encoding says nothing; url-safe characters stand for the others
    core = F.translate(F.rtrim("token", F.lit("=")), "-_", "+/")
    core = F.when(F.length("_alphabet") == 16, F.lower(core)).otherwise(core)
    rows = rows.withColumn("_c", F.split(core, ""))
    rows = rows.withColumn("_c", F.expr("filter(_c, x -> x <> '')"))
    rows = rows.withColumn("_v", F.expr("transform(_c, x -> cast(instr(_alphabet, x) as double))"))
    rows = rows.filter("size(_v) >= 16").withColumn("_n", F.size("_v").cast("double"))
    size = F.length("_alphabet").cast("double")
    rows = rows.withColumn(
        "_squares",
        F.expr("aggregate(array_distinct(_v), 0D, (s, x) -> s + power(size(filter(_v, y -> y = x)), 2))"),
    )
    chi = size * F.col("_squares") / F.col("_n") - F.col("_n")
    free = size - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    # only too uneven counts against a run
    p_chi = F.when(z_chi > 0, _normal_tail(z_chi) / 2).otherwise(F.lit(0.5))
    rows = rows.withColumn("_up", F.expr("transform(_v, x -> x > length(_alphabet) / 2)"))
    rows = rows.withColumn("_high", F.expr("cast(size(filter(_up, x -> x)) as double)"))
    rows = rows.withColumn("_runs", F.expr("1D + size(filter(_up, (x, i) -> i > 0 and x <> _up[i - 1]))"))
    high, low, n = F.col("_high"), F.col("_n") - F.col("_high"), F.col("_n")
    mean = 2 * high * low / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(var > 0, _normal_tail((F.col("_runs") - mean) / F.sqrt(var))).otherwise(F.lit(1e-9))
    rows = rows.withColumn("_mean", F.expr("aggregate(_v, 0D, (s, x) -> s + x) / _n"))
    rows = rows.withColumn("_var", F.expr("aggregate(_v, 0D, (s, x) -> s + (x - _mean) * (x - _mean))"))
    rows = rows.withColumn(
        "_cov",
        F.expr(
            "aggregate(transform(_v, (x, i) -> case when i > 0 then (x - _mean) * (_v[i - 1] - _mean) else 0D end), "
            "0D, (s, x) -> s + x)"
        ),
    )
    p_serial = F.when(F.col("_var") > 0, _normal_tail(F.sqrt(n) * F.col("_cov") / F.col("_var"))).otherwise(F.lit(1e-9))
    x = -2 * (F.log(p_chi) + F.log(p_runs) + F.log(p_serial))
    # tail of chi-squared with six degrees of freedom
    rows = rows.withColumn("p_random", F.exp(-x / 2) * (1 + x / 2 + x * x / 8))
    tables = {name: "array({})".format(", ".join(f"{v!r}D" for v in _prose(name == "caps"))) for name in ("prose", "caps")}
    for name, table in tables.items():
        rows = rows.withColumn(f"_{name}", F.expr(f"aggregate(_c, 0D, (s, x) -> s + element_at({table}, ascii(x) + 1))"))
    uniform = -F.col("_n") * F.log(size)
    log_p = F.least(F.lit(0.0), math.log(2) + F.greatest("_prose", "_caps") - uniform)
    return rows.withColumn("log_p", log_p)


def _spell(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id; n_assign, n_access, n_hex, n_random; base, all
    base spans, and spans, all spans, as arrays of (start, kind, end), by start, then kind.

    Positions are code points, ends exclusive; kind is an index into KINDS. Matches are leftmost
    and non-overlapping within their kind. Random runs never overlap a base span. A null or
    empty text has no spans; a null id stays null; repeated rows get equal spans; other
    columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"),
    )
    none = "cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"

    def where(guard: str, spans: str) -> str:
        guard = guard.replace("\\", "\\\\").replace("'", "\\'")
        return f"case when _t rlike '{guard}' then {spans} else {none} end"

    # hex runs under 32 and access keys under 16 characters fail: looking for long ones only is the same
    long_hex, long_access = "(?<![0-9a-f])[0-9a-f]{32,}", ACCESS.replace("+", "{12,}")
    rows = rows.withColumn(
        "_assign", F.expr(where(ASSIGN, _struct(_spans("_t", ASSIGN, 0, "length({g}) >= 8", "group"), 0)))
    )
    rows = rows.withColumn("_access", F.expr(where(long_access, _struct(_spans("_t", long_access, 1), 1))))
    rows = rows.withColumn("_hex", F.expr(where(long_hex, _struct(_spans("_t", long_hex, 2), 2))))
    runs = _spans("_t", RUN, 3, f"{{m}} rlike '{MIXED}'")
    rows = rows.withColumn(
        "_run",
        F.expr(
            f"case when _t rlike '{RUN}' then {runs} else "
            "cast(array() as array<struct<a:bigint,b:bigint,m:string,g:string>>) end"
        ),
    )
    rows = rows.withColumn("_base", F.expr("array_sort(concat(_assign, _access, _hex))"))
    rows = rows.withColumn(
        "_run", F.expr("filter(_run, r -> not exists(_base, s -> s.start < r.b and r.a < s.end))")
    )
    found = saved(
        rows.select(
            "_id",
            F.monotonically_increasing_id().alias("_row"),
            *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
            "_base",
            F.expr("transform(_run, r -> struct(r.a as start, 3 as kind, r.b as end, r.m as token))").alias("_run"),
        )
    )
    tested = saved(
        _battery(
            found.filter("size(_run) > 0").select("_row", F.explode("_run").alias("_r")).select("_row", "_r", "_r.token")
        ).select("_row", F.struct("_r.start", "_r.kind", "_r.end").alias("_span"), "log_p", "p_random")
    )
    cut = discovery_bound(tested)
    added = (
        tested.filter((F.col("p_random") >= NOT_RANDOM) & (F.col("log_p") <= cut))
        .groupBy("_row")
        .agg(F.collect_list("_span").alias("_more"))
    )
    out = found.join(added, "_row", "left")
    more = F.coalesce("_more", F.expr(none))
    return out.select(
        given_id().alias("doc_id"),
        *(f"n_{k}" for k in KINDS[:3]),
        F.size(more).cast("long").alias("n_random"),
        F.col("_base").alias("base"),
        F.array_sort(F.concat("_base", more)).alias("spans"),
    )


def discovery_bound(tested: DataFrame) -> float:
    """Benjamini-Hochberg on a histogram (LOGS * BINS bins): the largest log_p to accept."""
    bin_ = F.least(F.floor(-F.col("log_p") * BINS), F.lit(LOGS * BINS)).cast("int").alias("bin")
    random = (F.col("p_random") >= NOT_RANDOM).cast("long")
    bins = {r["bin"]: (r["n"], r["k"]) for r in tested.groupBy(bin_).agg(F.count("*").alias("n"), F.sum(random).alias("k")).collect()}
    total, found, bound = sum(n for n, _ in bins.values()), 0, float("-inf")
    for k in sorted(bins, reverse=True):
        found += bins[k][1]
        # the whole bin is accepted at its largest probability
        if found and -k / BINS + math.log(total) <= math.log(FALSE_DISCOVERIES * found):
            bound = -k / BINS
    return bound


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 of the base spans as text, spans as text."""
    return secret_spans(docs, id_col, text_col).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.expr(_spell("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_spell("spans")).alias("spans"),
        "n_random",
    )
