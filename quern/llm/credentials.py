"""Secret scans with multipart credential linking, in DataFrame functions only.

Three kinds of span are reported wherever they stand: assignments of a value to a secret's name, access key
identifiers and long hexadecimal strings.  Three weak kinds are common in harmless text and are reported only as
parts of a credential: named identifiers, bare strings of the length of a secret key, and endpoints.  Within a scope
(a number of code points between spans) an identifier needs a secret, a secret an identifier, an endpoint both;
access identifiers and the strong secrets count as complements.  A weak span that overlaps a strong one is not
reported again.

The interval join is a sweep in each row: spans are sorted by start, running maxima carry the furthest ends before
each, running minima from the back the nearest starts behind it, so no pairs are made and nothing is shuffled.  All
running results are scans by doubling steps over an array: n spans of a text cost n log n.

Positions count code points, ends are exclusive.  Defined cases: null and empty texts have no spans; a very long text
is one row, whose spans are arrays in it; spans that start together are sorted by kind; repeated rows stay repeated;
other columns are not looked at and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh

KINDS = ["assign", "access", "hex", "identifier", "key", "endpoint"]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "identifier": r"""(?i:access_?key_?id|client_?id|user_?name|account_?id|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    "key": r"[A-Za-z0-9+/]{40,}",
    "endpoint": r"""(?i:https?)://[^\x00-\x20"'<>]{4,}""",
}
#: Code points between complementary spans.
SCOPE = 200
#: Beyond any place in a text; code points of a piece of a text that is put together anew.
FAR, PIECE = 1 << 30, 512
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _power(k: Column) -> Column:
    return F.pow(F.lit(2.0), k).cast("int")


def _scan(values: Column, better: Callable[[Column, Column], Column], back: bool = False) -> Column:
    """The running result of an array up to each place (back: from each place on), by doubling steps.

    A fold over the steps replaces the whole array each time, so n values cost n log n; a fold that appends to its
    result would copy it n times.
    """
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")), _power)

    def double(now: Column, step: Column) -> Column:
        other = lambda x, i: F.get(now, i + step if back else i - step)
        return F.transform(now, lambda x, i: F.coalesce(better(x, other(x, i)), x))

    return F.aggregate(steps, values, double)


def _found(match: Column, text: Column, kind: str) -> Column:
    """The spans of a kind: its matches, placed by the lengths of what split leaves between."""
    pattern, number = PATTERNS[kind], KINDS.index(kind) + 1
    sizes = F.zip_with(match, F.split(text, pattern, -1), lambda m, g: F.coalesce(F.length(m), F.lit(0)) + F.length(g))
    ends = _scan(F.slice(sizes, F.lit(1), F.size(match)), lambda a, b: a + b)

    def span(m: Column, end: Column) -> Column:
        kept = F.lit(True)  # a match that fails has used up its text all the same
        if kind == "assign":
            kept = F.length(F.regexp_extract(m, pattern, 1)) >= 6
        if kind == "key":
            kept = (F.length(m) == 40) & m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
        return F.when(kept, F.struct((end - F.length(m)).alias("start"), F.lit(number).alias("kind"), end.alias("end")))

    spans = F.array_compact(F.zip_with(match, ends, span))
    return F.when(F.size(match) > 0, spans).otherwise(F.array()).cast(_SPANS)


def _reach(parts: Column, kinds: list[int], back: bool) -> Column:
    """For each part the furthest end of the parts of some kinds before it, or the nearest start of those behind it."""
    far = F.lit(FAR if back else -FAR)
    own = F.transform(parts, lambda p: F.when(p["kind"].isin(kinds), p["start"] if back else p["end"]).otherwise(far))
    run = _scan(own, F.least if back else F.greatest, back)
    return F.concat(F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0))), F.array(far)) if back else F.concat(F.array(far), F.slice(run, 1, F.greatest(F.size(run) - 1, F.lit(0))))


def _linked(seen: Column, scope: int) -> Column:
    """The spans of seen parts that are strong, or weak with their complements in scope and clear of strong ones."""

    def keep(p: Column) -> Column:
        named = (p["id"] >= p["start"] - scope) | (p["next_id"] <= p["end"] + scope)
        secret = (p["secret"] >= p["start"] - scope) | (p["next_secret"] <= p["end"] + scope)
        clear = (p["strong"] <= p["start"]) & (p["next_strong"] >= p["end"])
        return (p["kind"] <= 3) | (clear & F.when(p["kind"] == 4, secret).when(p["kind"] == 5, named).otherwise(named & secret))

    return F.transform(F.filter(seen, keep), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE, base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with two columns: `base`, the strong spans, and `spans`, these and the linked weak ones.

    Both are arrays of (start, kind, end) sorted by start and kind; kind is 1 for the first of KINDS and so on.
    Where docs has a column of that name already, underscores are put behind the new one's.
    """
    base, spans = fresh(docs, base, spans)
    held = fresh(docs.withColumns({base: F.lit(0), spans: F.lit(0)}), *[f"{k}_matches" for k in KINDS], "strong_spans", "weak_spans", "parts")
    matches, (strong, weak, parts) = held[:6], held[6:]
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({m: F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0)) for k, m in zip(KINDS, matches)})
    of = lambda some: F.concat(*[_found(F.col(matches[i]), body, KINDS[i]) for i in some])
    found = found.withColumns({strong: F.array_sort(of(range(3))), weak: of(range(3, 6))})
    found = found.withColumn(parts, F.when(F.size(weak) > 0, F.array_sort(F.concat(strong, weak))))
    reaches = {"id": [2, 4], "secret": [1, 3, 5], "strong": [1, 2, 3]}
    names = fresh(found, *[p + k for p in ("", "next_") for k in reaches])
    found = found.withColumns({n: F.when(F.col(parts).isNotNull(), _reach(F.col(parts), kinds, back)) for n, (back, kinds) in zip(names, [(b, k) for b in (False, True) for k in reaches.values()])})
    each = ["start", "kind", "end", *[p + k for p in ("", "next_") for k in reaches]]
    seen = F.transform(F.arrays_zip(parts, *names), lambda z: F.struct(*[z[parts][k].alias(k) for k in each[:3]], *[z[n].alias(k) for n, k in zip(names, each[3:])]))
    linked = F.when(F.col(parts).isNull(), F.col(strong)).otherwise(_linked(seen, scope))
    return found.select(*[F.col(c) for c in docs.columns], F.col(strong).alias(base), linked.alias(spans))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _pieces(text: Column, size: int = PIECE) -> Column:
    """The text in pieces of so many code points, the last one shorter: cut in halves again and again, so in n log n."""
    levels = F.greatest(F.ceil(F.log2(F.greatest(F.length(text), F.lit(1)) / size)), F.lit(0)).cast("int")

    def halve(now: Column, level: Column) -> Column:
        half = F.lit(size) * _power(level)
        return F.filter(F.flatten(F.transform(now, lambda s: F.array(F.substring(s, F.lit(1), half), F.substring(s, half + 1, half)))), lambda s: s != "")

    down = F.filter(F.sequence(levels - 1, F.lit(-1), F.lit(-1)), lambda k: k >= 0)
    return F.aggregate(F.when(levels > 0, down).otherwise(F.array().cast("array<int>")), F.array(text), halve)


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", scope: int = SCOPE, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of scan() replaced by a mark; overlapping spans are replaced as one, chars is counted anew where text changed.

    The text between two marks is taken from its pieces, so no span walks the whole text.  What a lambda looks up is a
    column that is used outside of it too: the optimiser would put one that is used once into the lambda, to be
    computed for every element.
    """
    base, spans, reach, ends, starts, cut, fixed = fresh(docs, "base", "spans", "reach", "hidden_ends", "hidden_starts", "text_pieces", "fixed_text")
    found, body, own = scan(docs, text, scope, base, spans), F.col(text), F.col(spans)
    touched = F.size(own) > 0
    found = found.withColumn(reach, F.when(touched, _scan(F.transform(own, lambda s: s["end"]), F.greatest)))
    opens = lambda i: (i == 0) | (F.get(own, i)["start"] >= F.get(F.col(reach), i - 1))
    places = F.sequence(F.lit(0), F.size(own) - 1)
    found = found.withColumns({
        starts: F.when(touched, F.concat(F.transform(F.filter(places, opens), lambda i: F.get(own, i)["start"]), F.array(F.length(body)))),
        ends: F.when(touched, F.concat(F.array(F.lit(0)), F.transform(F.filter(places, lambda i: (i == F.size(own) - 1) | opens(i + 1)), lambda i: F.get(F.col(reach), i)))),
        cut: F.when(touched, _pieces(body)),
    })

    def between(a: Column, z: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        near = F.array_join(F.slice(F.col(cut), first + 1, F.floor(z / PIECE).cast("int") - first + 1), "")
        return F.substring(near, a - first * PIECE + 1, z - a)

    found = found.withColumn(fixed, F.when(F.size(cut) > 0, F.array_join(F.zip_with(F.col(ends), F.col(starts), between), mark)).otherwise(body))
    recounted = F.when(touched, F.length(F.col(fixed))).otherwise(F.col(chars)).cast(docs.schema[chars].dataType) if chars else None
    return found.select(*[F.col(fixed).alias(c) if c == text else recounted.alias(c) if c == chars else F.col(c) for c in docs.columns])


def oracle(scope: int = SCOPE) -> str:
    """DuckDB SQL of the query: matches are placed by what lies between them, complements are looked up among all spans."""
    parts = []
    for number, kind in enumerate(KINDS, 1):
        pattern = PATTERNS[kind].replace("'", "''")
        keep = {"assign": "length(g) >= 6", "key": "length(m) = 40 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"}.get(kind, "true")
        group = 1 if kind == "assign" else 0
        parts.append(f"""
SELECT rid, {number} AS kind, CAST(spot AS BIGINT) AS a, CAST(spot + length(m) AS BIGINT) AS z FROM (
  SELECT rid, m, g, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM (
    SELECT rid, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, regexp_split_to_array(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')))
  WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE {keep}""")
    near = lambda kinds: f"EXISTS (SELECT 1 FROM s q WHERE q.rid = s.rid AND q.kind IN ({kinds}) AND q.a - s.z <= {scope} AND s.a - q.z <= {scope})"
    names = "['" + "','".join(KINDS) + "']"
    listing = f"string_agg({names}[kind] || ':' || a || ':' || z, ',' ORDER BY a, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
k AS (SELECT rid, kind, a, z FROM s WHERE kind <= 3 OR (NOT EXISTS (SELECT 1 FROM s q WHERE q.rid = s.rid AND q.kind <= 3 AND q.a < s.z AND s.a < q.z)
  AND CASE kind WHEN 4 THEN {near("1, 3, 5")} WHEN 5 THEN {near("2, 4")} ELSE {near("1, 3, 5")} AND {near("2, 4")} END)),
b AS (SELECT rid, count(*) FILTER (kind = 1) AS n_assign, count(*) FILTER (kind = 2) AS n_access, count(*) FILTER (kind = 3) AS n_hex, {listing} AS base FROM s WHERE kind <= 3 GROUP BY rid),
l AS (SELECT rid, {listing} AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)
"""
