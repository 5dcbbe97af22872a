"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Spans are code point positions, end exclusive, found by laying the matches of a pattern and the
gaps between them (the same pattern's split) end to end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import free_name, table

#: Code points before and after a span that are searched for context words.
NEAR = 40
#: An added span needs this score; spans of the base kinds stay whatever their score.
LEAST = 0.6
#: Running sums go over chunks of this size, so a text with n matches costs n * CHUNK steps, not n * n.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once for all its uses in `body`, inner lambdas included."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array under an associative merge."""

    def total(array: Column, start: Column, length: Column) -> Column:
        return F.aggregate(F.slice(array, start, length), zero, merge)

    def scan(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: total(v, c * CHUNK + 1, F.lit(CHUNK)))

        def with_sums(s: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda c: total(s, F.lit(1), c))

            def each(b: Column) -> Column:
                def at(i: Column) -> Column:
                    c = F.floor(i / CHUNK).cast("int")
                    return merge(F.get(b, c), total(v, c * CHUNK + 1, i % CHUNK + 1))

                return F.transform(F.sequence(F.lit(0), F.size(v) - 1), at)

            return let(before, each)

        return let(chunks, with_sums)

    return let(values, lambda v: F.when(F.size(v) > 0, scan(v)).otherwise(v))


def _add(a: Column, b: Column) -> Column:
    return a + b


def propose(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches."""

    def lay(p: Column) -> Column:
        steps = F.transform(p["hits"], lambda m, i: F.char_length(m) + F.char_length(F.get(p["gaps"], i)))

        def at(ends: Column) -> Column:
            return F.transform(p["hits"], lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match")))

        return let(running(steps, F.lit(0), _add), at)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")), lay)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    def check(d: Column) -> Column:
        doubled = F.translate(d, "0123456789", "0246813579")
        picked = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 0, F.substr(doubled, i, F.lit(1))).otherwise(F.substr(d, i, F.lit(1))).cast("int"))
        return F.aggregate(picked, F.lit(0), _add) % 10 == 0

    return let(F.reverse(_digits(m)), check)


def mod97(m: Column) -> Column:
    """The check of international account numbers: the first four characters go last, letters count from 10, the rest is 1."""

    def check(s: Column) -> Column:
        turned = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))
        codes = F.transform(F.split(turned, ""), lambda c: F.ascii(c))
        step = lambda acc, c: F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97
        return F.length(s).between(15, 34) & (F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0), step) == 1)

    return let(F.regexp_replace(m, " ", ""), check)


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Detector:
    kind: str
    pattern: str
    #: Cheap sign that a text may hold a match; the pattern itself if empty.
    mark: str
    valid: Callable[[Column], Column]
    base: bool
    #: Score of a confirmed match, and what a context word nearby adds.
    score: float
    context: tuple[str, ...] = ()
    bonus: float = 0.3


#: The patterns are written so that Java's backtracking matcher runs in linear time and without recursion: possessive
#: repeats, and no second start within a run of characters that has failed as a whole (\G: a run cut by the last match).
DETECTORS = (
    Detector("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), True, 0.9, ("mail", "contact", "write")),
    Detector("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "", lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), True, 0.7, ("ip", "host", "server", "address", "login")),
    Detector(
        "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])", "", luhn, True, 0.8, ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta")
    ),
    Detector("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(9, 15), True, 0.7, ("phone", "tel", "call", "mobile", "fax")),
    Detector(
        "iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", "", mod97, False, 0.7, ("iban", "account", "bank", "konto", "compte", "cuenta")
    ),
    Detector(
        "localphone", r"(?<![0-9A-Za-z+._-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z_])", "", lambda m: F.lit(True), False, 0.4, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")
    ),
)
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(text: Column, d: Detector) -> Column:
    near = r"(?i)(?<![\p{L}])(?:" + "|".join(d.context) + r")(?![\p{L}])"

    def scored(x: Column) -> Column:
        before = F.substr(text, F.greatest(x["start"] + 1 - NEAR, F.lit(1)), F.least(x["start"], F.lit(NEAR)))
        after = F.substr(text, x["end"] + 1, F.lit(NEAR))
        bonus = F.when(F.concat(before, F.lit(" \n "), after).rlike(near), d.bonus).otherwise(0.0)
        return F.struct(F.lit(d.kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (F.lit(d.score) + bonus).alias("score"))

    kept = F.transform(F.filter(propose(text, d.pattern), lambda x: d.valid(x["match"])), scored)
    if not d.base:
        kept = F.filter(kept, lambda x: x["score"] >= LEAST)
    may = F.contains(text, F.lit(d.mark)) if d.mark else text.rlike(d.pattern)
    return F.when(may, kept).otherwise(F.array()).cast(_SPAN)


def detect(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """All columns of df and `out_col`: array<struct<kind, start, end, score>> by kind in the order of DETECTORS, then start.

    A narrow projection in the JVM. Added kinds yield to base spans they overlap. A null or empty text has no spans; texts
    are searched whole; other columns stay as they are, and one named like `out_col` is replaced.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    base = [_spans(text, d) for d in DETECTORS if d.base]
    added = [_spans(text, d) for d in DETECTORS if not d.base]

    def join(p: Column) -> Column:
        free = F.filter(p["added"], lambda a: ~F.exists(p["base"], lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
        return F.concat(p["base"], free)

    both = let(F.struct(F.concat(*base).alias("base"), F.concat(*added).alias("added")), join)
    return df.withColumn(out_col, both)


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one, under the first one's kind) replaced by its kind in brackets."""

    def cut(p: Column) -> Column:
        ends = running(F.transform(p["s"], lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def pieces(e: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                done = F.when(i > 0, F.get(e, i - 1)).otherwise(0)
                return F.when(x["start"] >= done, F.concat(F.substr(p["t"], done + 1, x["start"] - done), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

            tail = F.substr(p["t"], F.get(e, F.size(e) - 1) + 1, F.char_length(p["t"]))
            return F.concat(F.array_join(F.transform(p["s"], piece), ""), tail)

        return let(ends, pieces)

    order = F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: x)
    return F.when(F.size(spans) > 0, let(F.struct(order.alias("s"), text.alias("t")), cut)).otherwise(text)


def masked(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows and columns of docs with personal data in the text replaced by [KIND]; `size_col`, if any, follows the text.

    Rows without a finding keep their values, nulls included.
    """
    spans = free_name(docs, "_pii")
    found = detect(docs, text_col, spans)
    some = F.size(spans) > 0
    out = {text_col: F.when(some, mask(F.col(text_col).cast("string"), F.col(spans))).otherwise(F.col(text_col))}
    found = found.withColumns(out)
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        found = found.withColumn(size_col, F.when(some, F.char_length(text_col)).otherwise(F.col(size_col)).cast(kind))
    return found.drop(spans)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, out_col: str = "pii") -> DataFrame:
    """The counts of the base kinds, a hash of the base spans and all spans as text."""
    kinds = [d.kind for d in DETECTORS if d.base]

    def count(kind: str) -> Column:
        return F.size(F.filter(out_col, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(out_col, lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col(out_col)).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows and null ids each give a row; an empty table gives none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digest(detect(docs))


def _sql() -> str:
    """The same in DuckDB: matches and gaps of the plain patterns, laid end to end."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
        "localphone": r"(?:^|[^0-9A-Za-z+._-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    number = f"list_transform(range(1, length({digits}) + 1), lambda i: substr(reverse({digits}), i, 1)::int * (2 - i % 2))"
    short = "replace(m, ' ', '')"
    turned = f"list_transform(list_filter(string_split(substr({short}, 5) || left({short}, 4), ''), lambda c: c <> ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)"
    valid = {
        "ip": "list_max(list_transform(string_split(m, '.'), lambda p: p::hugeint)) <= 255",
        "card": f"length({digits}) between 13 and 19 and list_sum(list_transform({number}, lambda v: case when v > 9 then v - 9 else v end)) % 10 = 0",
        "phone": f"length({digits}) between 9 and 15",
        "iban": f"length({short}) between 15 and 34 and list_reduce(list_prepend(0, {turned}), lambda a, v: (a * case when v > 9 then 100 else 10 end + v) % 97) = 1",
    }
    parts = []
    for rank, d in enumerate(DETECTORS):
        p, near = plain[d.kind], "(?i)(?:^|[^\\pL])(?:" + "|".join(d.context) + ")(?:$|[^\\pL])"
        # that pattern takes in the character before; a bracket at the text's start belongs to the number
        lead = "case when left(m, 1) between '0' and '9' or (left(m, 1) = '(' and e = length(m) and substr(m, 2, 1) <> '(') then 0 else 1 end" if d.kind == "localphone" else "0"
        parts.append(
            f"""select row_id, {rank} as rank, '{d.kind}' as kind, {d.base} as base, s as a, e as b from (
  select *, {d.score} + case when regexp_matches(substr(t, greatest(s + 1 - {NEAR}, 1), least(s, {NEAR})) || ' \n ' || substr(t, e + 1, {NEAR}), '{near}') then {d.bonus} else 0 end as score from (
    select row_id, t, m, e - length(m) + {lead} as s, e from (
      select row_id, t, m, (sum(length(gap) + length(m)) over (partition by row_id order by i))::bigint as e from (
        select row_id, t, generate_subscripts(ms, 1) as i, unnest(ms) as m, unnest(gaps[1:len(ms)]) as gap
        from (select row_id, t, regexp_extract_all(t, '{p}') as ms, string_split_regex(t, '{p}') as gaps from d) where len(ms) > 0))
    where {valid.get(d.kind, "true")}))
where {"true" if d.base else f"score >= {LEAST}"}"""
        )
    kinds = [d.kind for d in DETECTORS if d.base]
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in kinds)
    zeros = ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in kinds)
    return f"""
with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(parts)}),
kept as (select * from found f where base or not exists (select 1 from found g where g.row_id = f.row_id and g.base and g.a < f.b and f.a < g.b)),
sums as (
  select row_id, {counts},
    string_agg(kind || ':' || a::bigint || ':' || b::bigint, ',' order by rank, a) filter (base) as listed,
    string_agg(kind || ':' || a::bigint || ':' || b::bigint, ',' order by rank, a) as spans
  from kept group by 1)
select doc_id, {zeros}, sha256(coalesce(listed, '')) as base_sha256, coalesce(spans, '') as spans
from d left join sums using (row_id)"""


ORACLE = _sql()
