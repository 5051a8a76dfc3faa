"""Secret scan: assigned passwords, access keys, long hex strings, and strings of high local entropy. Native Spark only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table, text_or_empty
from tickloom.llm.registry import query

C = F.col

#: Fixed patterns. A match that is too short is dropped and not searched again.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy scan: runs of base64 and URL-safe letters with a digit among them.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least peak entropy, in bits a character over a window of 20 (at most log2 20 = 4.32), by the class of characters of a candidate.
THRESHOLDS = {"hex": 3.0, "upper": 3.4, "lower": 3.6, "mixed": 3.8}
#: Candidates that are no secrets: ids in the 8-4-4-4-12 form, runs without a letter, and well-known samples.
ALLOWED = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[0-9+/_=-]+$", r"(?i)example|sample|placeholder|changeme|dummy|xxxx|abcdefgh|12345678")


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """``array<struct<start, kind, end, found>>`` of all leftmost non-overlapping matches, in code points, end exclusive.

    What the pattern splits a text into and what it matches alternate, so running sums of both lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.slice(F.split(text, pattern), 1, F.size(found)), found, lambda gap, m: F.struct(F.coalesce(F.length(gap), F.lit(0)).alias("gap"), m.alias("found")))

    def step(done: Column, x: Column) -> Column:
        begin = F.when(F.size(done) > 0, F.element_at(done, -1)["end"]).otherwise(F.lit(0)) + x["gap"]
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + F.length(x["found"])).alias("end"), x["found"].alias("found"))
        return F.concat(done, F.array(one))

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(pattern), F.aggregate(pieces, none, step)).otherwise(none)


_SPAN = "struct<start:int,kind:string,end:int,found:string>"


def character_class(token: Column) -> Column:
    return F.when(token.rlike("^[0-9a-fA-F]+$"), "hex").when(~token.rlike("[a-z]"), "upper").when(~token.rlike("[A-Z]"), "lower").otherwise("mixed")


def peak_entropy(token: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits a character) of any ``window`` characters in a row; 0 for shorter strings.

    One pass: the state holds the count of every distinct character in the window and S, the sum of c log2 c over them. A
    step adds the character that enters, takes off the one that leaves and corrects S by what those two counts change;
    the entropy is log2(window) - S / window.
    """
    letters = F.array_distinct(F.split(token, ""))
    weight = lambda c: F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(0.0)
    state = F.struct(F.transform(letters, lambda _: F.lit(0)).alias("n"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("least"))

    def shifted(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda c, k: F.when(k + 1 == at, c + by).otherwise(c))

    def step(st: Column, i: Column) -> Column:
        enters = F.array_position(letters, F.substring(token, i, F.lit(1))).cast("int")
        leaves = F.array_position(letters, F.substring(token, F.greatest(i - window, F.lit(1)), F.lit(1))).cast("int")
        full = i > window
        before = F.element_at(st["n"], enters)
        added = F.struct(shifted(st["n"], enters, 1).alias("n"), (st["s"] + weight(before + 1) - weight(before)).alias("s"))
        # A one-element transform names the intermediate state, so that it is computed once.
        return F.element_at(F.transform(F.array(added), lambda a: F.struct(
            F.when(full, shifted(a["n"], leaves, -1)).otherwise(a["n"]).alias("n"),
            F.when(full, a["s"] + weight(F.element_at(a["n"], leaves) - 1) - weight(F.element_at(a["n"], leaves))).otherwise(a["s"]).alias("s"),
            st["least"].alias("least"))), 1)

    def ranked(st: Column, i: Column) -> Column:
        return F.element_at(F.transform(F.array(step(st, i)), lambda x: F.struct(
            x["n"].alias("n"), x["s"].alias("s"), F.when(i >= window, F.least(x["least"], x["s"])).otherwise(x["least"]).alias("least"))), 1)

    out = F.aggregate(F.sequence(F.lit(1), F.length(token)), state, ranked, lambda st: F.log2(F.lit(float(window))) - st["least"] / window)
    return F.when(F.length(token) >= window, F.greatest(out, F.lit(0.0))).otherwise(0.0)


def _secret(token: Column) -> Column:
    limit = F.element_at(F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))]), character_class(token))
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | token.rlike(pattern)
    return token.rlike("[0-9]") & ~allowed & (peak_entropy(token) >= limit)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns; the value of an ``assign`` has 6 characters or more."""
    assign = F.filter(match_spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6)
    return F.concat(assign, match_spans(text, ACCESS, "access"), match_spans(text, HEX, "hex"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: base spans and all spans of every whole text, each ``struct<start, kind, end, found>``.

    Spans come by start, then kind as listed, then end. ``entropy`` adds the other candidate strings that hold a digit and whose
    peak entropy reaches their class's threshold, unless the allow-list names them or a base span overlaps them.
    Null texts count as empty and have no spans; rows that share a doc_id are scanned one by one; an empty table gives no rows.
    """
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def sort(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["kind"], s["end"], s["found"]))

    df = docs.select(C("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    df = df.select("doc_id", sort(base_spans(C("text"))).alias("base"), match_spans(C("text"), CANDIDATE, "entropy").alias("candidates"))
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    df = df.select("doc_id", "base", F.filter(free, lambda c: _secret(c["found"])).alias("more"))
    return df.select("doc_id", "base", sort(F.concat("base", "more")).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


_SECRETS_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, rank, pattern) AS (VALUES ('assign', 0, '{ASSIGN.replace("'", "''")}'), ('access', 1, '{ACCESS}'), ('hex', 2, '{HEX}'), ('entropy', 3, '{CANDIDATE}')),
m AS (SELECT rid, kind, rank, regexp_extract_all(t, pattern) AS f, string_split_regex(t, pattern) AS g FROM d, k WHERE regexp_matches(t, pattern)),
p AS (SELECT rid, kind, rank, unnest(f) AS found, unnest(range(1, len(f) + 1)) AS i, f, g FROM m),
s AS (SELECT rid, kind, rank, found, (list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN f[1:i - 1]]), 0))::BIGINT AS a FROM p),
r AS (SELECT *, a + length(found) AS e FROM s),
b AS (SELECT * FROM r WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(regexp_extract(found, '{ASSIGN.replace("'", "''")}', 2)) >= 6),
c AS (SELECT *, CASE WHEN regexp_full_match(found, '[0-9a-fA-F]+') THEN {THRESHOLDS["hex"]} WHEN NOT regexp_matches(found, '[a-z]') THEN {THRESHOLDS["upper"]}
  WHEN NOT regexp_matches(found, '[A-Z]') THEN {THRESHOLDS["lower"]} ELSE {THRESHOLDS["mixed"]} END AS least FROM r WHERE kind = 'entropy' AND regexp_matches(found, '[0-9]')
  AND NOT regexp_matches(found, '{ALLOWED[0]}') AND NOT regexp_matches(found, '{ALLOWED[1]}') AND NOT regexp_matches(found, '{ALLOWED[2]}')
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = r.rid AND b.a < r.e AND r.a < b.e)),
v AS (SELECT rid, a, found, unnest(range(1, length(found) - {WINDOW - 2})) AS w FROM c),
l AS (SELECT rid, a, w, unnest(string_split(substring(found, w, {WINDOW}), '')) AS ch FROM v),
n AS (SELECT rid, a, w, ch, count(*) AS n FROM l GROUP BY ALL),
h AS (SELECT rid, a, w, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS bits FROM n GROUP BY ALL),
t AS (SELECT rid, a, max(bits) AS bits FROM h GROUP BY ALL),
o AS (SELECT rid, kind, rank, a, e, TRUE AS base FROM b UNION ALL SELECT c.rid, kind, rank, c.a, e, FALSE FROM c JOIN t ON c.rid = t.rid AND c.a = t.a WHERE bits >= least),
j AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank, e) FILTER (WHERE base) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank, e) AS spans FROM o GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (rid)
"""


@query("op6_secrets", _SECRETS_SQL)
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(C("base")).cast("binary"), 256).alias("base_sha256"), joined(C("spans")).alias("spans"))
