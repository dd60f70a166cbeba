"""Secrets in text: assignments, access keys, hex strings, and stretches of high entropy.

All of it is one projection of built-in expressions, so nothing is shuffled and a text is searched
whole in its own row. Places of matches come from the pieces between them: where a match starts is
the sum of the lengths before it.

Entropy: a candidate is a stretch of symbols of one character class. A window of fixed width slides
over it; the counts of the symbols in the window are kept as the characters of a string, one place
per symbol, and each step changes the count of the symbol that leaves and of the one that enters. The
sum of c * log2(c) over the counts follows by a table of whole millionths, so the entropy of a window
is exact and the same everywhere. Windows with at least the bits of their class make spans, and those
that overlap or touch are one. A candidate with an allow-listed text gives none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmargin.llm.arrays import column, fresh


def either_case(words: str) -> str:
    """A pattern of A-Z letters in either case; other characters stay."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


# Kind, pattern, measured group, least characters of that group.
_KEY = either_case("(password|passwd|secret|token|api_?key)")
BASE = (
    ("assign", _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is found whole, and a shorter one fails anyway
)

# Kind, symbols, window, least bits a symbol of a window in thousandths.
CLASSES = (
    ("hex_entropy", "[0-9A-Fa-f]", 20, 3000),
    ("base64_entropy", "[A-Za-z0-9+/_=-]", 24, 4000),
)
KINDS = tuple(kind for kind, *_ in (*BASE, *CLASSES))

# Candidates that contain one of these are no secrets.
ALLOWED = (
    either_case("example"),
    either_case("placeholder"),
    either_case("changeme"),
    either_case("your[_-]"),
    "0123456789",
    "abcdefghij",
    "ABCDEFGHIJ",
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
)
_MIXED = ("[0-9]", "[A-Za-z]")  # a candidate has both

_CHUNK = 256
_FIRST_SYMBOL = ord("+") - 1  # places of symbols in a string of counts start at 1
_SYMBOLS = ord("z") - _FIRST_SYMBOL
_ZERO = ord("!")  # the character of a count of 0
_MILLION = 1_000_000


def weighted_log(count: int) -> int:
    """count * log2(count) in whole millionths."""
    return round(_MILLION * count * math.log2(count)) if count > 1 else 0


def most_concentration(window: int, millibits: int) -> int:
    """The largest sum of ``weighted_log`` over the counts of a window with at least so many bits."""
    return weighted_log(window) - window * millibits * (_MILLION // 1000)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: an array of one value stands for a local name."""
    return F.get(F.transform(F.array(value), use), 0)


def _struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


_NO_SPANS = "array<struct<start:bigint,stop:bigint,value:string>>"


def _no_spans() -> Column:
    return F.array().cast(_NO_SPANS)


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``start, stop, value`` of the leftmost non-overlapping matches, in code points; those whose
    ``group`` has fewer than ``least`` characters are dropped.

    Lengths are summed in chunks, so that the cost of many matches stays near linear.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = [F.split(text, pattern).alias("gap"), found.alias("value")]
    if group:
        zipped.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("measured"))
    # the last piece has no match after it
    steps = F.filter(F.arrays_zip(*zipped), lambda one: one["value"].isNotNull())

    def placed(part: Column, at: Column) -> Column:
        """The spans of a chunk, and where the chunk ends."""

        def step(state: Column, one: Column) -> Column:
            start = state["at"] + F.length(one["gap"])
            stop = start + F.length(one["value"])
            keep = F.length(one["measured" if group else "value"]) >= least
            span = _struct(start=start, stop=stop, value=one["value"])
            return _struct(at=stop, spans=F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]))

        return F.aggregate(part, _struct(at=at, spans=_no_spans()), step)

    def over(steps: Column) -> Column:
        def chunk(state: Column, number: Column) -> Column:
            part = placed(F.slice(steps, number * _CHUNK + 1, _CHUNK), state["at"])
            return _bound(part, lambda p: _struct(at=p["at"], lists=F.concat(state["lists"], F.array(p["spans"]))))

        first = _struct(at=F.lit(0).cast("bigint"), lists=F.array().cast(f"array<{_NO_SPANS}>"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int"))
        return F.flatten(F.aggregate(chunks, first, chunk, lambda state: state["lists"]))

    return F.when(text.rlike(pattern), _bound(steps, over)).otherwise(_no_spans())


def _hot_stretches(value: Column, window: int, millibits: int) -> Column:
    """``start, stop`` in ``value`` of the stretches that windows with enough entropy cover."""
    limit = most_concentration(window, millibits)
    logs = F.array(*[F.lit(weighted_log(count)).cast("bigint") for count in range(window + 2)])
    spans = "array<struct<start:int,stop:int>>"

    def flushed(state: Column) -> Column:
        last = F.array(_struct(start=state["start"], stop=state["stop"]))
        return F.when(state["stop"] > 0, F.concat(state["spans"], last)).otherwise(state["spans"])

    def judged(state: Column, full: Column) -> dict[str, Column]:
        """The present window, if it is full, joins the open stretch or closes it and opens one."""
        hot = full & (state["total"] <= limit)
        begin = state["seen"] - window
        apart = hot & (begin > state["stop"]) | hot & (state["stop"] == 0)
        return {
            "start": F.when(apart, begin).otherwise(state["start"]),
            "stop": F.when(hot, state["seen"]).otherwise(state["stop"]),
            "spans": F.when(apart, flushed(state)).otherwise(state["spans"]),
        }

    def step(state: Column, event: Column) -> Column:
        """A positive event is the place of a symbol that enters, a negative one of one that leaves."""
        place = F.abs(event)
        count = F.ascii(F.substring(state["counts"], place, F.lit(1))) - _ZERO
        after = count + F.signum(event).cast("int")
        return _struct(
            counts=F.overlay(state["counts"], F.char(after + _ZERO), place, F.lit(1)),
            total=state["total"] + F.get(logs, after) - F.get(logs, count),
            seen=F.when(event > 0, state["seen"] + 1).otherwise(state["seen"]),
            **judged(state, event < 0),
        )

    def events(places: Column) -> Column:
        return F.flatten(
            F.transform(
                places,
                lambda place, k: F.when(k >= window, F.array(-F.get(places, k - window), place)).otherwise(F.array(place)),
            )
        )

    places = F.transform(F.split(value, ""), lambda c: F.ascii(c) - _FIRST_SYMBOL)
    empty = _struct(
        counts=F.lit(chr(_ZERO) * _SYMBOLS), total=F.lit(0).cast("bigint"), seen=F.lit(0),
        start=F.lit(0), stop=F.lit(0), spans=F.array().cast(spans),
    )

    def finish(state: Column) -> Column:
        return _bound(_struct(**judged(state, state["seen"] >= window)), flushed)

    return F.aggregate(_bound(places, events), empty, step, finish)


def _of_class(text: Column, symbols: str, window: int, millibits: int) -> Column:
    pattern = f"{symbols}{{{window},}}"
    allowed = "|".join(ALLOWED)

    def hot(candidate: Column) -> Column:
        value = candidate["value"]
        worth = ~value.rlike(allowed)
        for one in _MIXED:
            worth = worth & value.rlike(one)
        inside = F.when(worth, _hot_stretches(value, window, millibits)).otherwise(
            F.array().cast("array<struct<start:int,stop:int>>")
        )
        return F.transform(
            inside,
            lambda s: _struct(start=candidate["start"] + s["start"], stop=candidate["start"] + s["stop"], value=F.lit("")),
        )

    return F.flatten(F.transform(matches(text, pattern), hot))


def _tagged(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda s: _struct(start=s["start"], number=F.lit(number), stop=s["stop"]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of ``start, number, stop`` by start, then kind; ``number`` is
    the kind's place in ``KINDS``. A same-named column goes.

    Places are code points of the whole text, ``stop`` exclusive. Null, empty and blank texts have an
    empty array; repeated rows and ids are rows of their own, and an empty table gives an empty one.
    """
    held = fresh(docs, "scanned_text")
    others = [column(c) for c in docs.columns if c.lower() != "secrets"]
    source = docs.select(*others, F.coalesce(column(text).cast("string"), F.lit("")).alias(held))
    raw = F.col(held)
    lists = [matches(raw, pattern, group, least) for _, pattern, group, least in BASE]
    lists += [_of_class(raw, symbols, window, millibits) for _, symbols, window, millibits in CLASSES]
    tagged = [_tagged(spans, number) for number, spans in enumerate(lists)]
    return source.select(*others, F.sort_array(F.concat(*tagged)).alias("secrets"))


def span_text(secrets: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    texts = F.transform(
        secrets,
        lambda s: F.concat_ws(":", F.get(names, s["number"]), s["start"].cast("string"), s["stop"].cast("string")),
    )
    return F.array_join(texts, ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    secrets = F.col("secrets")

    def counted(number: int) -> Column:
        return F.size(F.filter(secrets, lambda s: s["number"] == number)).cast("long").alias(f"n_{KINDS[number]}")

    counts = [counted(number) for number in range(len(BASE))]
    base = F.filter(secrets, lambda s: s["number"] < len(BASE))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(secrets).alias("spans"),
    )


def _sql() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def found(number: int, pattern: str, group: int, least: int) -> str:
        p = quoted(pattern)
        return f"""SELECT r, {number} AS number, {least} AS least, unnest(range(len(regexp_extract_all(t, {p})))) AS k,
        unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(regexp_extract_all(t, {p}, {group})) AS measured,
        unnest(regexp_split_to_array(t, {p})[1:len(regexp_extract_all(t, {p}))]) AS gap FROM texts WHERE regexp_matches(t, {p})"""

    searches = [found(n, pattern, group, least) for n, (_, pattern, group, least) in enumerate(BASE)]
    cases = ["0"] * len(BASE)
    limits = ["0"] * len(BASE)
    for n, (_, symbols, window, millibits) in enumerate(CLASSES, len(BASE)):
        searches.append(found(n, f"{symbols}{{{window},}}", 0, 0))
        cases.append(str(window))
        limits.append(str(most_concentration(window, millibits)))
    most = max(window for _, _, window, _ in CLASSES)
    logs = "[" + ", ".join(str(weighted_log(c)) for c in range(1, most + 1)) + "]"
    names = "[" + ", ".join(f"'{kind}'" for kind in KINDS) + "]"
    mixed = " AND ".join(f"regexp_matches(m, {quoted(one)})" for one in _MIXED)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), found AS ({' UNION ALL '.join(searches)}
), placed AS (
    SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, number ORDER BY k) AS BIGINT) AS stop FROM found
), spans AS (
    SELECT r, number, stop - length(m) AS start, stop, m FROM placed WHERE length(measured) >= least
), windows AS (
    SELECT r, number, start, m, [{', '.join(cases)}][number + 1] AS width, unnest(range(length(m) - width + 1)) AS w
    FROM spans WHERE number >= {len(BASE)} AND {mixed} AND NOT regexp_matches(m, {quoted('|'.join(ALLOWED))})
), symbols AS (
    SELECT r, number, start, width, w, unnest(string_split(substr(m, w + 1, width), '')) AS c FROM windows
), counted AS (
    SELECT r, number, start, width, w, count(*) AS n FROM symbols GROUP BY r, number, start, width, w, c
), hot AS (
    SELECT r, number, start, width, w FROM counted GROUP BY r, number, start, width, w HAVING sum({logs}[n]) <= [{', '.join(limits)}][number + 1]
), marked AS (
    SELECT *, w - lag(w) OVER (PARTITION BY r, number, start ORDER BY w) <= width AS joined FROM hot
), grouped AS (
    SELECT *, count(*) FILTER (joined IS NOT TRUE) OVER (PARTITION BY r, number, start ORDER BY w) AS part FROM marked
), every AS (
    SELECT r, number, start, stop FROM spans WHERE number < {len(BASE)}
    UNION ALL SELECT r, number, start + min(w), start + max(w) + any_value(width) FROM grouped GROUP BY r, number, start, part
), lists AS (
    SELECT r, {', '.join(f"count(*) FILTER (number = {n}) AS n_{BASE[n][0]}" for n in range(len(BASE)))},
        string_agg({names}[number + 1] || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < {len(BASE)}) AS base,
        string_agg({names}[number + 1] || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans
    FROM every GROUP BY r
)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in BASE)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN lists USING (r)
"""


OP12_SQL = _sql()
