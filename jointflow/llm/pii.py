"""Personal data in texts, with DataFrame functions only.

Each kind has a regular expression that proposes spans (leftmost, not overlapping), a validator that confirms them
(Luhn's checksum, mod 97, number ranges, digit counts; keys and secrets by form), and words that, near a span, raise its score. Spans of
base kinds are kept once confirmed; those of the other kinds need a score of ``LEAST_SCORE`` and no
overlap with a base span.

Positions follow from the pieces between matches, so one pass of a pattern gives the matches and one the places. The
patterns start where a run of characters starts and use possessive steps: no text makes them go back over
what they have read, or nest deeply, however long it is.

Null and empty texts have no spans, repeated rows repeat their result, an empty table gives an empty table, and a
column named like the new one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointflow.llm.common import whole_text

LEAST_SCORE = 0.5
#: Code points before and after a span in which context words count.
NEAR = 48
CONTEXT_WEIGHT = 0.3

# Countries with international bank account numbers.
IBAN_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ "
    "LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
).split()

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    backward = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(backward, i, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, leave 1 when divided by 97."""
    turned = F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float  # of a confirmed span without context
    context: str  # words, as a pattern over lower-cased text
    needs: str  # a character without which no span can be
    base: bool = False
    beside: str | None = None  # characters that may not stand next to a span


#: Four capitals or digits, at least one of them a digit.
_FOUR = "(?:[0-9][A-Z0-9]{3}|[A-Z][0-9][A-Z0-9]{2}|[A-Z]{2}[0-9][A-Z0-9]|[A-Z]{3}[0-9])"
_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True), 0.7, r"mail|contact|write|address", "@", base=True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), 0.6, r"\bip\b|server|host|login|address", ".", base=True,
    ),
    Kind(
        # A whole run of digits with single separators; runs of other lengths are no cards.
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        lambda m: luhn(digits_of(m)), 0.7, r"card|visa|credit|debit|payment|expir", "", base=True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m: F.length(digits_of(m)).between(8, 15), 0.6, r"phone|\btel|call|mobile|fax|contact", "+", base=True,
    ),
    Kind(
        "iban",
        "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
        lambda m: F.substring(m, 1, 2).isin(IBAN_COUNTRIES) & mod97(m), 0.6, r"iban|bank|account", "", beside="[A-Za-z0-9]",
    ),
    Kind(
        # In groups of four; groups after the bank's hold a digit, so that words in capitals are left out.
        "iban_grouped",
        rf"[A-Z]{{2}}[0-9]{{2}}\x20[A-Z0-9]{{4}}(?:\x20{_FOUR}){{1,6}}(?:\x20[A-Z0-9]{{0,2}}[0-9])?",
        lambda m: F.substring(m, 1, 2).isin(IBAN_COUNTRIES) & mod97(F.replace(m, F.lit(" "))), 0.6, r"iban|bank|account", "",
        beside="[A-Za-z0-9]",
    ),
    Kind(
        # Keys that show by their first characters whose they are.
        "key",
        r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}",
        lambda m: F.lit(True), 0.8, r"key|token|secret", "", beside="[A-Za-z0-9]",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+",
        lambda m: (F.length(digits_of(m)) >= 3) & m.rlike("[A-Za-z]"), 0.3, r"token|secret|password|passwd|credential|api.?key|\bauth", "",
        beside="[_-]",
    ),
    Kind(
        "national_number",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda m: ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9")
        & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"),
        0.5, r"social|\bssn\b|tax|identity", "-", beside=r"[A-Za-z0-9.-]",
    ),
    Kind(
        "phone_local",
        r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
        lambda m: F.lit(True), 0.3, r"phone|\btel|call|mobile|fax", "", beside=r"[A-Za-z0-9+.-]",
    ),
)

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_FOUND = "array<struct<start:int,end:int,match:string>>"


def _found(text: Column, kind: Kind) -> Column:
    """Places and strings of the pattern's matches."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # The piece after the last match has none beside it.
    zipped = F.arrays_zip(matches.alias("match"), F.split(text, kind.pattern, -1).alias("gap"))

    def add(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        more = F.struct(end.alias("at"), F.concat(seen["spans"], F.array(span)).alias("spans"))
        return F.when(x["match"].isNull(), seen).otherwise(more)

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("spans"))
    spans = F.aggregate(zipped, first, add, lambda s: s["spans"])
    possible = text.rlike(kind.pattern)
    if kind.needs:
        possible = text.contains(kind.needs) & possible
    return F.when(possible, spans).otherwise(F.array().cast(_FOUND))


def _confirmed(text: Column, kind: Kind, found: Column) -> Column:
    """Confirmed spans with their scores."""

    def scored(x: Column) -> Column:
        start = F.greatest(x["start"] - NEAR, F.lit(0))
        before = F.substring(text, start + 1, x["start"] - start)
        after = F.substring(text, x["end"] + 1, F.lit(NEAR))
        near = F.lower(F.concat(before, F.lit(" "), after)).rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, CONTEXT_WEIGHT).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    def good(x: Column) -> Column:
        ok = kind.valid(x["match"])
        if kind.beside:
            left = F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise("")
            right = F.substring(text, x["end"] + 1, F.lit(1))
            ok = ok & ~left.rlike(kind.beside) & ~right.rlike(kind.beside)
        return ok

    spans = F.transform(F.filter(found, good), scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)


def find_spans(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with ``spans``: kind, start and end (code points, end exclusive) and score, by kind as listed, then by start."""
    names = {k.name: f"_found_{k.name}" for k in kinds}
    rows = df.withColumn("_text", whole_text(text))
    rows = rows.withColumns({names[k.name]: _found(F.col("_text"), k) for k in kinds})
    rows = rows.withColumns({names[k.name]: _confirmed(F.col("_text"), k, F.col(names[k.name])) for k in kinds})
    rows = rows.withColumn("_base", F.concat(F.array().cast(SPANS), *[F.col(names[k.name]) for k in kinds if k.base]))
    clear = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    others = [F.filter(names[k.name], clear) for k in kinds if not k.base]
    rows = rows.withColumn("spans", F.concat("_base", *others))
    return rows.drop("_text", "_base", *names.values())


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` (with ``spans``) with every span of ``text`` replaced by its kind in brackets; overlapping spans by the first."""
    whole = whole_text(text)

    def add(seen: Column, s: Column) -> Column:
        between = F.substring(whole, seen["at"] + 1, s["start"] - seen["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["start"] >= seen["at"]
        return F.struct(
            F.greatest(seen["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(seen["pieces"], F.array(between, mark))).otherwise(seen["pieces"]).alias("pieces"),
        )

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))
    changed = F.aggregate(ordered, first, add, lambda s: F.concat(F.array_join(s["pieces"], ""), F.substring(whole, s["at"] + 1, F.length(whole))))
    return df.withColumn(text, F.when(F.size("spans") > 0, changed).otherwise(F.col(text)))


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def oracle() -> str:
    """Query results as SQL over ``documents``, with the base kinds' patterns in their plain form."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "secret": "[A-Za-z0-9]{24,}",
    }
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, text, {n} AS rank, '{k.name}' AS kind, {k.base} AS base, {k.score} AS score, '{k.context}' AS context, "
        f"{'NULL' if k.beside is None else repr(k.beside)} AS beside, regexp_extract_all(text, '{plain.get(k.name, k.pattern)}') AS found, "
        f"string_split_regex(text, '{plain.get(k.name, k.pattern)}') AS gaps FROM docs"
        for n, k in enumerate(KINDS)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)
    zeros = ", ".join(f"coalesce(s.n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in KINDS if k.base)
    return f"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
kinds AS ({kinds}),
each AS (
  SELECT * EXCLUDE (found, gaps), unnest(found) AS match, unnest(gaps[:len(found)]) AS gap, unnest(range(len(found))) AS i
  FROM kinds WHERE len(found) > 0),
placed AS (
  SELECT *, sum(length(gap)) OVER w + sum(length(match)) OVER w - length(match) AS start, sum(length(gap)) OVER w + sum(length(match)) OVER w AS stop,
         regexp_replace(match, '[^0-9]', '', 'g') AS digits, replace(match[5:], ' ', '') || match[:4] AS turned
  FROM each WINDOW w AS (PARTITION BY doc_id, text, kind ORDER BY i)),
valid AS (
  SELECT *, score + CASE WHEN regexp_matches(lower(
             text[greatest(start - {NEAR}, 0) + 1:start] || ' ' || text[stop + 1:stop + {NEAR}]), context) THEN {CONTEXT_WEIGHT} ELSE 0 END AS total
  FROM placed WHERE CASE kind
    WHEN 'email' THEN TRUE
    WHEN 'ip' THEN regexp_full_match(match, '{OCTET}(?:\\.{OCTET}){{3}}')
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum([CASE WHEN j % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END
      FOR d, j IN [c::INT FOR c IN string_split(reverse(digits), '')]]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'secret' THEN length(digits) >= 3 AND regexp_matches(match, '[A-Za-z]')
    WHEN 'national_number' THEN match[:3] NOT IN ('000', '666') AND match[1] <> '9' AND match[5:6] <> '00' AND match[8:] <> '0000'
    WHEN 'key' THEN TRUE
    WHEN 'phone_local' THEN TRUE
    ELSE match[:2] IN ({', '.join(map(repr, IBAN_COUNTRIES))})
      AND list_reduce(list_prepend(0, [CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE 1000 + ascii(c) - 55 END FOR c IN string_split(turned, '')]),
        lambda r, v: CASE WHEN v >= 1000 THEN (r * 100 + v - 1000) % 97 ELSE (r * 10 + v) % 97 END) = 1
    END
  AND (beside IS NULL OR NOT (start > 0 AND regexp_matches(text[start:start], beside) OR regexp_matches(text[stop + 1:stop + 1], beside)))),
kept AS (
  SELECT * FROM valid v WHERE base OR total >= {LEAST_SCORE} AND NOT EXISTS (
    SELECT 1 FROM valid b WHERE b.base AND b.doc_id IS NOT DISTINCT FROM v.doc_id AND b.text = v.text AND b.start < v.stop AND v.start < b.stop)),
summed AS (
  SELECT doc_id, text, {counts}, count(*) AS n_spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (base) AS base_spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans
  FROM kept GROUP BY doc_id, text)
SELECT d.doc_id, {zeros}, coalesce(s.n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(s.base_spans, '')) AS base_sha256, coalesce(s.spans, '') AS spans
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d LEFT JOIN summed s ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.text = d.text"""
