"""Secret scan: fixed forms, and a battery of randomness tests on every long token.

Base forms are assignments, access keys and long hexadecimal strings. Every other run of at least ``LEAST`` key characters
with a letter and a digit is a candidate. A run with slashes is also cut at them, for a token may stand in a path or an address, and
pieces that still mix two alphabets are cut at their other marks; every piece of ``LEAST`` characters is a candidate of its own, and one
inside a longer discovered candidate is not listed again. The encoding is inferred from the characters used; over that alphabet of A codes
it goes through a chi-squared test of uniform use, a runs test above and below the middle code and a lag-one serial
correlation test. Together (Fisher) they must not reject "uniformly random" at ``REJECT``.

Against that stands the null "structured like names or words": repeat rate ``KAPPA`` of codes, which puts the chi-squared
statistic of n characters around A (1 + (n - 1) kappa) - n, and runs of capitals, small letters and digits that are longer
than random ones: neighbours change class at most ``RUNS`` times as often. The p-value of a candidate under it (Fisher over both) shrinks with its length, so short tokens need more. Secrets
are the candidates discovered at false-discovery rate ``RATE`` (step-up over all candidates of the corpus, separately by
encoding and length band, on p-values rounded up to a fixed grid).

DataFrame and SQL functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fitted, packed
from tabloom.llm.spans import SPAN, found, listed, normal_tail, tagged

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}"
RATE = 0.05
REJECT = 0.001
RUNS = 0.65
GRID = 50  # steps of the p-value grid per power of ten
MASK = "[SECRET]"

# Encodings, the characters they use in code order, and the pattern that infers them (first match counts).
ENCODINGS = [
    ("hex", "0123456789abcdef", "^[0-9a-f]+$", 0.10),
    ("HEX", "0123456789ABCDEF", "^[0-9A-F]+$", 0.10),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$", 0.065),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789", "^[a-z0-9]+$", 0.065),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "^[A-Za-z0-9]+$", 0.065),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[A-Za-z0-9+/]+$", 0.065),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^[A-Za-z0-9_-]+$", 0.065),
]
BANDS = (32, 64)
ENCODED = "(c.value rlike '^[A-Za-z0-9+/]+$' or c.value rlike '^[A-Za-z0-9_-]+$')"


def _change_rate(alphabet: str) -> float:
    """How often neighbours of a uniformly random string differ in class."""
    sizes = [sum(map(test, alphabet)) for test in (str.isupper, str.islower, str.isdigit)]
    sizes.append(len(alphabet) - sum(sizes))
    return 1 - sum(n * n for n in sizes) / len(alphabet) ** 2


def _encoding(value: str) -> str:
    return "case " + " ".join(f"when {value} rlike '{p}' then {i}" for i, (_, _, p, _) in enumerate(ENCODINGS)) + " end"


def _per_encoding(code: str, field) -> str:
    return f"case {code} " + " ".join(f"when {i} then {field(e)}" for i, e in enumerate(ENCODINGS)) + " end"


def _pieces(spans: str, mark: str) -> str:
    """The parts of ``spans`` between marks (one character each) that are long enough."""
    grown = (
        f"aggregate(split(c.value, '{mark}'), struct(c.start as at, cast(array() as {SPAN}) as out), (acc, v) -> struct(acc.at + length(v) + 1 as at, "
        f"case when length(v) >= {LEAST} then array_append(acc.out, struct(acc.at as start, acc.at + length(v) as stop, v as value)) else acc.out end as out), acc -> acc.out)"
    )
    return f"flatten(transform({spans}, c -> {grown}))"


def _candidates(runs: str) -> str:
    """Runs with an encoding, the parts between slashes of those that have some, and where these fit no encoding, theirs in turn."""
    parts = _pieces(f"filter({runs}, c -> contains(c.value, '/'))", "/")
    rest = f"filter(concat(filter({runs}, c -> not contains(c.value, '/')), {parts}), c -> not {ENCODED})"
    return f"concat(filter({runs}, c -> {ENCODED}), filter({parts}, c -> {ENCODED}), {_pieces(rest, '[+_-]')})"


def _battery(candidates: str) -> str:
    """Array of tested candidates: start, stop, stratum, step (grid step of the structured p-value), random."""
    alphabet = _per_encoding("c.enc", lambda e: f"'{e[1]}'")
    size = _per_encoding("c.enc", lambda e: len(e[1]))
    kappa = _per_encoding("c.enc", lambda e: e[3])
    band = f"(case when c.n < {BANDS[0]} then 0 when c.n < {BANDS[1]} then 1 else 2 end)"
    a = f"filter(transform({candidates}, c -> struct(c.start as start, c.stop as stop, c.value as value, {_encoding('c.value')} as enc)), c -> c.enc is not null)"
    a = f"transform({a}, c -> struct(c.start as start, c.stop as stop, c.enc as enc, cast(length(c.value) as double) as n, cast({size} as double) as k, cast({kappa} as double) as kappa, " \
        f"length(regexp_replace(c.value, '(?<=[A-Z])(?=[^A-Z])|(?<=[a-z])(?=[^a-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])', ' ')) - length(c.value) as changes, " \
        f"transform(split(c.value, ''), ch -> cast(instr({alphabet}, ch) - 1 as double)) as x))"  # fmt: skip
    # sum of squared code counts, from runs of equal codes after sorting
    squares = (
        "aggregate(array_sort(c.x), struct(cast(-1 as double) as last, 0D as run, 0D as total), (s, v) -> struct(v as last, "
        "case when v = s.last then s.run + 1 else 1D end as run, s.total + case when v = s.last then 2 * s.run + 1 else 1D end as total), s -> s.total)"
    )
    walk = (
        "aggregate(c.x, struct(cast(null as double) as last, 0D as high, 0D as turns, 0D as sx, 0D as sxx, 0D as sxy), (s, v) -> struct(v as last, "
        "s.high + case when v >= c.k / 2 then 1 else 0 end as high, s.turns + case when s.last is not null and (v >= c.k / 2) <> (s.last >= c.k / 2) then 1 else 0 end as turns, "
        "s.sx + v as sx, s.sxx + v * v as sxx, s.sxy + coalesce(v * s.last, 0D) as sxy))"
    )
    a = f"transform({a}, c -> struct(c.start as start, c.stop as stop, c.enc as enc, c.n as n, c.k as k, c.kappa as kappa, c.changes as changes, c.x[0] as x0, element_at(c.x, -1) as x1, {squares} as sq, {walk} as w))"
    mean = "(c.w.sx / c.n)"
    spread = f"greatest(1e-9, c.w.sxx - c.n * {mean} * {mean})"
    serial = f"((c.w.sxy - {mean} * (2 * c.w.sx - c.x0 - c.x1) + (c.n - 1) * {mean} * {mean}) / {spread})"
    expected_runs = "(2 * c.w.high * (c.n - c.w.high) / c.n + 1)"
    a = (
        f"transform({a}, c -> struct(c.start as start, c.stop as stop, c.enc as enc, c.n as n, c.k as k, c.kappa as kappa, c.changes as changes, "
        f"c.k / c.n * c.sq - c.n as chi, (c.w.turns + 1 - {expected_runs}) / sqrt(greatest(1e-9, ({expected_runs} - 1) * ({expected_runs} - 2) / (c.n - 1))) as z_runs, "
        f"({serial} + 1 / c.n) * sqrt(c.n) as z_serial))"
    )
    df = "(c.k - 1)"
    z_chi = f"((power(greatest(c.chi, 1e-9) / {df}, 1 / 3D) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df})))"
    s_mean = "(c.k * (1 + (c.n - 1) * c.kappa) - c.n)"
    s_var = "(c.k * c.k / (c.n * c.n) * (4 * c.n * c.n * c.n * 0.6 * c.kappa * c.kappa + 2 * c.n * c.n * c.kappa))"
    s_chi = f"(({s_mean} - c.chi) / sqrt({s_var}))"
    rate = "(" + _per_encoding("c.enc", lambda e: round(RUNS * _change_rate(e[1]), 6)) + ")"
    s_runs = f"((c.changes - {rate} * (c.n - 1)) / sqrt({rate} * (1 - {rate}) * (c.n - 1)))"
    a = (
        f"transform({a}, c -> struct(c.start as start, c.stop as stop, c.enc * 3 + {band} as stratum, "
        f"-ln({normal_tail(z_chi)}) - ln(2 * {normal_tail('abs(c.z_runs)')}) - ln(2 * {normal_tail('abs(c.z_serial)')}) as against_random, "
        f"-ln({normal_tail(s_chi)}) - ln({normal_tail(s_runs)}) as against_structure))"
    )
    # Fisher: 2 * sum is chi-squared with 6 and 4 degrees of freedom
    p_random = "(exp(-c.against_random) * (1 + c.against_random + c.against_random * c.against_random / 2))"
    p_structure = "(exp(-c.against_structure) * (1 + c.against_structure))"
    return (
        f"transform({a}, c -> struct(c.start as start, c.stop as stop, cast(c.stratum as int) as stratum, "
        f"cast(floor(-{GRID} * log10(least(1D, {p_structure}))) as int) as step, {p_random} >= {REJECT} as random))"
    )


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (fixed forms, by start and kind) and ``_tested`` (candidates with their test results) added."""
    text = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    text = text.withColumn("_assign", found("_t", ASSIGN, value=2)).withColumn("_assign", F.expr("filter(_assign, s -> length(s.value) >= 6)"))
    text = text.withColumn("_access", found("_t", ACCESS, "contains(_t, 'AKIA')")).withColumn("_hex", found("_t", HEX))
    base = f"array_sort(concat({tagged('_assign', 'assign', 0)}, {tagged('_access', 'access', 1)}, {tagged('_hex', 'hex', 2)}))"
    text = text.withColumn("_base", F.expr(base)).withColumn("_c", found("_t", CANDIDATE))
    free = "filter(_c, s -> s.value rlike '[0-9]' and s.value rlike '[A-Za-z]' and not exists(_base, b -> b.start < s.stop and s.start < b.stop))"
    odd = "exists(_c, c -> contains(c.value, '/') or contains(c.value, '+'))"
    text = text.withColumn("_c", F.expr(f"case when size(_c) > 0 and {odd} then {_candidates('_c')} else _c end"))
    text = text.withColumn("_c", F.expr(f"case when size(_c) > 0 then {free} else _c end"))
    tested = _battery("_c")
    empty = "cast(array() as array<struct<start:int,stop:int,stratum:int,step:int,random:boolean>>)"
    return text.withColumn("_tested", F.expr(f"case when size(_c) > 0 then {tested} else {empty} end")).drop("_t", "_assign", "_access", "_hex", "_c")


def discovery_steps(scanned: DataFrame) -> dict[int, int]:
    """Smallest grid step that counts as a discovery, by stratum: the step-up rule over the counts per grid step.

    A step stands for the p-value 10 ** (-step / GRID), rounded up. At most one row per stratum reaches the driver.
    """
    steps = scanned.select(F.explode("_tested").alias("c")).groupBy("c.stratum", "c.step").agg(F.count("*").alias("n"))
    ranked = steps.selectExpr(
        "stratum", "step", "sum(n) over (partition by stratum order by step desc) as at_most", "sum(n) over (partition by stratum) as all"
    )  # at most a few hundred grid steps in a stratum
    kept = ranked.where(F.expr(f"power(10D, -step / {GRID}D) <= {RATE} * at_most / all")).groupBy("stratum").agg(F.min("step"))
    return {r[0]: r[1] for r in kept.collect()}


def _secret(steps: dict[int, int]) -> str:
    rule = reduce(lambda out, s: f"{out} or (c.stratum = {s} and c.step >= {steps[s]})", sorted(steps), "false")
    found_ = f"filter(_tested, c -> c.random and ({rule}))"
    inside = "exists(p, o -> o.start <= c.start and c.stop <= o.stop and o.stop - o.start > c.stop - c.start)"
    return f"transform(array({found_}), p -> filter(p, c -> not {inside}))[0]"


def all_spans(steps: dict[int, int]) -> Column:
    return F.expr(f"array_sort(concat(_base, {tagged(_secret(steps), 'random', 3)}))")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``spans`` (arrays of start, place, stop, kind; code points, end exclusive).

    Null and empty texts have no spans. Repeated rows have equal spans; each of their candidates counts for the discovery rate.
    """
    scanned = fitted(scan(docs.select("doc_id", "text")).drop("text"), "secrets")
    return scanned.select("doc_id", F.col("_base").alias("base"), all_spans(discovery_steps(scanned)).alias("spans"))


def digest(found_spans: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found_spans.select(
        "doc_id", *counts, F.expr(f"sha2({listed('base')}, 256)").alias("base_sha256"), F.expr(listed("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask (overlapping ones by one); no row is dropped.

    Columns keep their names and order; ``n_chars``, if there, follows the new text. Null texts stay null.
    """
    # stored once, so that the battery does not run again for the spans
    scanned = packed(scan(docs.select(F.struct(*docs.columns).alias("_row"), "text")).drop("text"), "secrets").withColumn("text", F.col("_row.text"))
    spans = scanned.withColumn("_spans", all_spans(discovery_steps(scanned.select("_tested"))))
    cut = (
        "aggregate(_spans, struct(0 as at, '' as done), (acc, s) -> case when s.start < acc.at then struct(greatest(acc.at, s.stop) as at, acc.done as done) "
        f"else struct(s.stop as at, concat(acc.done, substring(text, acc.at + 1, s.start - acc.at), '{MASK}') as done) end, "
        "acc -> concat(acc.done, substring(text, acc.at + 1)))"
    )
    changed = F.size("_spans") > 0
    out = spans.withColumn("_text", F.when(changed, F.expr(cut)).otherwise(F.col("text")))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
