"""Personal data: fixed forms, and bootstrapped contextual extraction of further identifiers.

The fixed forms (mail and network addresses, card and phone numbers) are seeds. What stands next to them induces lexical
patterns: the two words before, and the word before with the word after (lower case, digits as 0). Patterns and the strings
they surround form a graph. Round by round a pattern's confidence for a kind is the mean confidence of its distinct strings
(smoothed by ``SMOOTH`` unknown ones), and a string's confidence is the chance that not all of its patterns are wrong, seeds
being certain. Patterns need ``SUPPORT`` distinct seeds. After ``ROUNDS`` rounds, identifier-like strings standing in a pattern
of confidence ``SURE`` whose own confidence reaches it are discovered: words, and digit groups joined by single blanks, dots,
brackets or hyphens. Of discovered strings that lie in one another only the longest is listed.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fitted
from tabloom.llm.spans import found, listed, tagged

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
SURE = 0.8
SMOOTH = 0.5
CONTEXT = (64, 1024)  # code points looked at first on either side for neighbouring words; then the whole side

LOCAL = "A-Za-z0-9._%+-"
LABEL = "A-Za-z0-9-"
# Separators that can join a run are turned into one control character first: then each form is a plain run of one class,
# which the matcher walks without recursion however long it is.
JOINT = "\u0001"
EMAIL = rf"(?:(?<![{JOINT}{LOCAL}])|\G)[{JOINT}{LOCAL}]+@[{LABEL}]+{JOINT}[{JOINT}{LABEL}]*"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = rf"[0-9][0-9{JOINT}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: words with an at sign or a digit
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@0-9]*[@0-9][^\x20\x09-\x0D]*"
#: digit groups with what may join them; one plain run, so that its length does not matter
GROUPS = r"(?<![A-Za-z0-9])(?:[A-Z]{2})?[0-9(][\x20().0-9-]*[0-9]"

SPAN_OUT = "array<struct<start:int,place:int,stop:int,kind:string>>"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


#: right to left, every second digit doubled, nines cast out
LUHN = (
    "aggregate(transform(split(reverse({d}), ''), (ch, i) -> case when i % 2 = 0 then int(ch) when int(ch) > 4 then 2 * int(ch) - 9 else 2 * int(ch) end), "
    "0, (a, v) -> a + v) % 10 = 0"
)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (fixed forms by kind, then start) and ``_near`` (identifier-like words outside them) and ``_seen``
    (both, with their neighbouring words)."""
    text = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    text = text.withColumn("_digit", F.expr("_t rlike '[0-9]'"))
    text = text.withColumn(
        "_mail_text",
        F.expr(rf"case when contains(_t, '@') then regexp_replace(translate(_t, '{JOINT}', '\u0002'), '(?<=[{LABEL}])\\.(?=[{LABEL}])', '{JOINT}') else '' end"),
    )
    text = text.withColumn(
        "_card_text",
        F.expr(rf"case when _digit then regexp_replace(translate(_t, '{JOINT}', '\u0002'), '(?<=[0-9])[\\x20-](?=[0-9])', '{JOINT}') else '' end"),
    )
    text = text.withColumn("_email", found("_mail_text", EMAIL, "contains(_mail_text, '@')"))
    text = text.withColumn("_ip", found("_t", IP, "_digit and _t rlike '[0-9]\\\\.[0-9]+\\\\.[0-9]+\\\\.[0-9]'"))
    text = text.withColumn("_card", found("_card_text", CARD, rf"_card_text rlike '[0-9](?:{JOINT}?[0-9]){{15}}'"))
    text = text.withColumn("_phone", found("_t", PHONE, "contains(_t, '+') and _digit"))
    octets = "forall(split(s.value, '\\\\.'), p -> length(ltrim('0', p)) < 4 and int(concat('0', right(p, 3))) <= 255)"
    text = text.withColumn("_ip", F.expr(f"case when size(_ip) > 0 then filter(_ip, s -> {octets}) else _ip end"))
    digits = _digits("s.value")
    text = text.withColumn(
        "_card", F.expr(f"case when size(_card) > 0 then filter(_card, s -> case when length({digits}) between 16 and 19 then {LUHN.format(d=digits)} else false end) else _card end")
    )
    text = text.withColumn("_phone", F.expr(f"case when size(_phone) > 0 then filter(_phone, s -> length({digits}) between 8 and 15) else _phone end"))
    base = "concat(" + ", ".join(tagged(f"_{k}", k, i) for i, k in enumerate(KINDS)) + ")"
    text = text.withColumn("_base", F.expr(base))
    # identifier-like: 6 characters and 4 digits, or an at sign inside; marks around a word do not belong to it
    word = found("_t", WORD, "_digit or contains(_t, '@')")
    text = text.withColumn("_w", word)
    trimmed = (
        "transform(_w, s -> struct(s.start + length(s.value) - length(ltrim('([{<\"\\'.,;:!?', s.value)) as start, s.stop - length(s.value) + length(rtrim(')]}>\"\\'.,;:!?', s.value)) as stop, s.value as value))"
    )
    like = (
        f"filter({trimmed}, s -> s.stop - s.start >= 6 and (length({_digits('s.value')}) >= 4 or s.value rlike '[^@]@[^@]') "
        "and not exists(_base, b -> b.start < s.stop and s.start < b.stop))"
    )
    text = text.withColumn("_near", F.expr(f"case when size(_w) > 0 then {like} else _w end"))
    text = text.withColumn("_g", found("_t", GROUPS, "_digit and _t rlike '[0-9][\\\\x20().-]{1,2}[0-9]'"))
    grouped = (
        f"filter(_g, s -> s.value rlike '[0-9][\\\\x20().-]+[0-9]' and not contains(s.value, '  ') and s.stop - s.start >= 6 and length({_digits('s.value')}) >= 4 "
        "and not exists(_base, b -> b.start < s.stop and s.start < b.stop) and not exists(_near, b -> b.start = s.start and b.stop = s.stop))"
    )
    text = text.withColumn("_near", F.expr(f"case when size(_g) > 0 then concat(_near, {grouped}) else _near end"))
    places = "concat(transform(_base, s -> struct(s.start as start, s.stop as stop, s.kind as seed)), transform(_near, s -> struct(s.start as start, s.stop as stop, cast(null as string) as seed)))"
    blank = "[\\\\x20\\\\x09-\\\\x0D]+"
    # the words of each side, from a window that is widened only where it does not hold them whole
    def before(size: str) -> str:
        return f"filter(split(regexp_replace(lower(substring(_t, greatest(s.start - {size}, 0) + 1, least(s.start, {size}))), '[0-9]', '0'), '{blank}'), x -> x <> '')"

    def after(size: str) -> str:
        return f"filter(split(regexp_replace(lower(substring(_t, s.stop + 1, {size})), '[0-9]', '0'), '{blank}'), x -> x <> '')"

    near_words = (
        f"transform({places}, s -> struct(s.start as start, s.stop as stop, s.seed as seed, substring(_t, s.start + 1, s.stop - s.start) as value, "
        f"{before(str(CONTEXT[0]))} as before, {after(str(CONTEXT[0]))} as after))"
    )
    for held, size in zip(CONTEXT, (*map(str, CONTEXT[1:]), "length(_t)")):
        near_words = (
            f"transform({near_words}, s -> struct(s.start as start, s.stop as stop, s.seed as seed, s.value as value, "
            f"case when size(s.before) > 2 or s.start <= {held} then s.before else {before(size)} end as before, "
            f"case when size(s.after) > 1 or length(_t) - s.stop <= {held} then s.after else {after(size)} end as after))"
        )
    patterns = (
        f"transform({near_words}, s -> struct(s.start as start, s.stop as stop, s.seed as seed, s.value as value, array_compact(array("
        "case when size(s.before) > 1 then concat('L ', s.before[size(s.before) - 2], ' ', s.before[size(s.before) - 1]) end, "
        "case when size(s.before) > 0 and size(s.after) > 0 then concat('B ', s.before[size(s.before) - 1], ' _ ', s.after[0]) end)) as patterns))"
    )
    none = "cast(array() as array<struct<start:int,stop:int,seed:string,value:string,patterns:array<string>>>)"
    text = text.withColumn("_seen", F.expr(f"case when size(_base) + size(_near) > 0 then {patterns} else {none} end"))
    return text.drop("_t", "_digit", "_mail_text", "_card_text", "_w", "_g", "_near", *(f"_{k}" for k in KINDS))


def pattern_confidence(seen: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confidence of every supported pattern (pattern, kind, conf) and of every string in one (value, kind, conf).

    ``seen`` has value, seed (kind or null) and pattern. Its distinct links are counted before any shuffle of rows.
    """
    links = fitted(seen.select("pattern", "value", "seed").distinct(), "links")
    size = links.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    support = links.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.countDistinct("value").alias("seeds")).where(f"seeds >= {SUPPORT}")
    supported = fitted(support.join(size, "pattern"), "patterns")
    graph = fitted(links.select("pattern", "value").distinct().join(supported.select("pattern", "kind", "n"), "pattern"), "graph")
    sure = links.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct().withColumn("certain", F.lit(1.0))
    strings = sure.withColumnRenamed("certain", "conf")
    patterns = None
    for _ in range(rounds):
        patterns = fitted(
            graph.join(strings, ["value", "kind"]).groupBy("pattern", "kind", "n").agg(F.sum("conf").alias("total"))
            .select("pattern", "kind", F.round(F.col("total") / (F.col("n") + SMOOTH), 9).alias("conf")), "patterns",
        )
        reached = graph.join(patterns, ["pattern", "kind"]).groupBy("value", "kind").agg(
            F.round(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf"))))), 9).alias("conf")
        )
        strings = fitted(
            reached.join(sure, ["value", "kind"], "left").select("value", "kind", F.coalesce("certain", "conf").alias("conf")), "strings"
        )
    return patterns, strings


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``spans`` (arrays of start, place, stop, kind; code points, end
    exclusive), ordered by kind, then start; discovered kinds are called ``found_<kind>`` and come last.

    Null and empty texts have no spans. Repeated rows get equal spans and count once as evidence. A string that several kinds
    claim gets the most confident one, by name on ties.
    """
    rows = fitted(scan(docs.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("_h"), "_base", "_seen"), "private")
    seen = rows.where(F.size("_seen") > 0).select("doc_id", "_h", F.explode("_seen").alias("s")).select("doc_id", "_h", "s.*")
    flat = seen.select("doc_id", "_h", "start", "stop", "seed", "value", F.explode("patterns").alias("pattern"))
    patterns, strings = pattern_confidence(flat, rounds)
    good = patterns.where(F.col("conf") >= SURE).select("pattern", "kind")
    known = strings.where(F.col("conf") >= SURE)
    hits = (
        flat.where("seed is null").join(good, "pattern").join(known, ["value", "kind"])
        .groupBy("doc_id", "_h", "start", "stop").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
        .groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("place"), "stop", F.concat(F.lit("found_"), "kind").alias("kind")))).alias("_more"))
        .withColumn("_more", F.expr("filter(_more, s -> not exists(_more, o -> o.start <= s.start and s.stop <= o.stop and o.stop - o.start > s.stop - s.start))"))
        .withColumnsRenamed({"doc_id": "_d", "_h": "_dh"})
    )
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_dh")), "left")
    return out.select("doc_id", F.col("_base").alias("base"), F.expr(f"concat(_base, coalesce(_more, cast(array() as {SPAN_OUT})))").alias("spans"))


def digest(found_spans: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found_spans.select(
        "doc_id", *counts, F.expr(f"sha2({listed('base')}, 256)").alias("base_sha256"), F.expr(listed("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_found"),
    )
