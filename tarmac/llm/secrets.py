"""Secret scans with multipart linking, in DataFrame functions only.

Strong kinds (assign, access, hex) are reported wherever they occur. Weak kinds are ordinary-looking
parts of a credential: other access identifiers, unnamed mixed-case keys of 40 characters or more,
and endpoints. Each part opens a scope of `radius` code points on both sides of its start, and a weak
part is reported only if the scope holds the parts that complement it: an identifier needs a secret,
a secret an identifier, an endpoint both. A part that overlaps another doesn't complement it, since
both may be one string.

The interval join of parts and scopes makes no pairs. The starts and ends of a text's parts are sorted by
position; running windows in both directions carry, for each class, the last start of a part that has ended
and the first start of one that is still to come, and a complement lies in the scope if one of these two
does. Parts are keyed by a row number, so repeated ids stay apart and the only key that grows is one text.
Texts themselves aren't shuffled for spans, and once for redaction.

Null or empty text: no spans. Null ids and repeated rows: one result each. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, test that spares most texts the full pattern, class, and test of a match
KINDS = {
    "assign": (ASSIGN, None, "secret"),
    "access": (r"AKIA[A-Z0-9]{12,}", "AKIA", "access"),
    "hex": (r"[0-9a-f]{32,}", None, "secret"),
    "weak_access": (r"(?:ASIA|AIDA|AROA|LTAI|GOOG)[A-Z0-9]{12,}", None, "access"),
    "weak_secret": (r"[A-Za-z0-9+/]{40,}", None, "secret"),
    "endpoint": (r"(?:https?|postgres|mysql|redis|mongodb|amqp|jdbc:[a-z]+)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", "://", "endpoint"),
}
STRONG = ("assign", "access", "hex")
RADIUS = 300
_LONG_VALUE = 8


def _passes(kind: str, match: Column) -> Column:
    """Whether a match counts; matches that don't still consume their characters."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= _LONG_VALUE
    if kind == "weak_secret":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def _parts(kind: str, text: Column) -> Column:
    """array<struct<kind, i, gap, len, ok>>: code points between matches and in them."""
    pattern, hint, _ = KINDS[kind]
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("len"), _passes(kind, match).alias("ok")))
    found = F.transform(F.filter(found, lambda x: x["len"].isNotNull()), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))
    return F.when(text.contains(hint) if hint else text.rlike(pattern), found)


def find_secrets(df: DataFrame, text: str = "text", radius: int = RADIUS, mask: str | None = None) -> DataFrame:
    """The columns of `df` without its text (and any column spans), and spans array<struct<kind, start, end>>.

    Spans are in code points, end exclusive, by start and then kind as in KINDS. With a mask the text stays,
    each stretch that overlapping spans cover replaced by it; the text then goes through the shuffle once.
    """
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    carried = [c for c in df.columns if (c != text or mask is not None) and c != "spans"]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    none = F.struct(F.lit("").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(False).alias("ok"))
    typed = "array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>"
    parts = F.concat(F.array(none).cast(typed), *[F.coalesce(_parts(k, body), F.array()).cast(typed) for k in KINDS])
    rows = df.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("__of") if carried else F.lit(None).alias("__of"), parts.alias("__p"))
    rows = rows.select("__row", "__of", F.explode("__p").alias("__p")).select("__row", F.when(F.col("__p.kind") == "", F.col("__of")).alias("__of"), "__p.*").repartition("__row")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("__row", "kind").orderBy("i"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok or kind = ''")
    linked = _linked(rows, radius).where(F.col("kind").isin("", *STRONG) | F.col("linked"))
    span = F.struct("start", order[F.col("kind")].alias("o"), "kind", "end")
    wanted = [F.first("__of", True).alias("__of"), F.array_sort(F.collect_list(F.when(F.col("kind") != "", span))).alias("spans")]
    if mask is not None:
        # of each stretch of overlapping spans: where the one before it ends, and where it starts
        before = F.max(F.when(F.col("kind") != "", F.col("end"))).over(Window.partitionBy("__row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1))
        linked = linked.withColumn("__free", F.coalesce(before, F.lit(0)))
        fresh = (F.col("kind") != "") & (F.col("start") >= F.col("__free"))
        wanted += [F.array_sort(F.collect_list(F.when(fresh, F.struct("start", "__free")))).alias("__stretches"), F.max("end").alias("__last")]
    out = linked.groupBy("__row").agg(*wanted)
    spans = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if mask is None:
        return out.select(*[F.col("__of")[c].alias(c) for c in carried], spans.alias("spans"))
    body = F.col("__of")[text].cast("string")
    out = out.withColumn("__blocks", F.when(F.size("spans") > 0, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))))
    return out.select(*[(F.when(F.size("spans") > 0, _masked(mask)).otherwise(body) if c == text else F.col("__of")[c]).alias(c) for c in carried], spans.alias("spans"))


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """(__row, kind, i, __of, start, end, linked): whether the scope of a part holds its complements."""
    classes = {c: [k for k in KINDS if KINDS[k][2] == c] for c in ("access", "secret")}
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("pos"), F.lit(False).alias("opens")))
    rows = rows.select("__row", "__of", "kind", "i", "start", "end", F.explode(F.when(F.col("kind") == "", F.slice(ends, 1, 1)).otherwise(ends)).alias("__e")).select("*", "__e.*").drop("__e")
    back, ahead = (Window.partitionBy("__row").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0) for by in (("pos", "opens"), (F.desc("pos"), F.desc("opens"))))
    near = {}
    for c, kinds in classes.items():
        at = F.when(F.col("kind").isin(kinds), F.col("start"))
        rows = rows.withColumn(f"__b_{c}", F.max(F.when(~F.col("opens"), at)).over(back)).withColumn(f"__a_{c}", F.min(F.when(F.col("opens"), at)).over(ahead))
        near[c] = F.coalesce(F.max(F.when(F.col("opens"), F.col("start") - F.col(f"__b_{c}") <= radius).otherwise(F.col(f"__a_{c}") - F.col("start") <= radius)), F.lit(False))
    out = rows.groupBy("__row", "kind", "i").agg(F.first("__of", True).alias("__of"), F.first("start").alias("start"), F.first("end").alias("end"), *[x.alias(c) for c, x in near.items()])
    linked = F.when(F.col("kind") == "weak_access", F.col("secret")).when(F.col("kind") == "weak_secret", F.col("access")).when(F.col("kind") == "endpoint", F.col("access") & F.col("secret"))
    return out.select("__row", "kind", "i", "__of", "start", "end", F.coalesce(linked, F.lit(False)).alias("linked"))


#: Code points in each block of a text that is cut up for masking, so that a gap costs its own length.
_BLOCK = 4096


def _masked(mask: str) -> Column:
    """The text of __blocks, each of __stretches replaced by `mask`."""

    def gap(a: Column, b: Column) -> Column:
        first = F.floor(a / _BLOCK).cast("int")
        n = F.floor(b / _BLOCK).cast("int") - first + 1
        return F.substring(F.array_join(F.slice("__blocks", first + 1, n), ""), (a % _BLOCK + 1).cast("int"), (b - a).cast("int"))

    pieces = F.transform("__stretches", lambda s: F.concat(gap(s["__free"], s["start"]), F.lit(mask)))
    rest = gap(F.col("__last"), F.size("__blocks") * _BLOCK)
    return F.concat(F.array_join(pieces, ""), rest)


def without_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with secrets in text masked, and n_chars (if it's there) what the new text has."""
    if "spans" in docs.columns:  # it makes room, and comes back
        return without_secrets(docs.withColumnRenamed("spans", "__spans"), mask).select(*[F.col("__spans").alias(c) if c == "spans" else F.col(f"`{c}`") for c in docs.columns])
    found = find_secrets(docs, mask=mask)
    return found.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return found.select("doc_id", *[count(k) for k in STRONG], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ok = {"assign": f"length(regexp_extract(m, {quote(ASSIGN)}, 2)) >= {_LONG_VALUE}", "weak_secret": "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"}
    found = " UNION ALL ".join(
        f"SELECT rid, '{k}' AS kind, {o} AS o, i, gaps[i] AS gap, ms[i] AS m, ({ok.get(k, 'true').replace('(m,', '(ms[i],')}) AS ok FROM (SELECT rid, regexp_split_to_array(text, {quote(p)}) AS gaps, regexp_extract_all(text, {quote(p)}) AS ms, unnest(range(1, len(regexp_extract_all(text, {quote(p)})) + 1)) AS i FROM d WHERE regexp_matches(text, {quote(p)}))"
        for o, (k, (p, _, _)) in enumerate(KINDS.items())
    )
    of = lambda c: ", ".join(f"'{k}'" for k, x in KINDS.items() if x[2] == c)
    near = lambda c: f"EXISTS (SELECT 1 FROM placed q WHERE q.rid = p.rid AND q.kind IN ({of(c)}) AND abs(q.s - p.s) <= {RADIUS} AND (q.e <= p.s OR q.s >= p.e))"
    strong = ", ".join(f"'{k}'" for k in STRONG)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (SELECT rid, kind, o, e, e - n AS s FROM (SELECT rid, kind, o, ok, length(m) AS n, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM found) WHERE ok),
kept AS (SELECT rid, kind, o, s, kind || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM placed p WHERE kind IN ({strong}) OR (kind = 'weak_access' AND {near('secret')}) OR (kind = 'weak_secret' AND {near('access')}) OR (kind = 'endpoint' AND {near('access')} AND {near('secret')})),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in STRONG)}, string_agg(x, ',' ORDER BY s, o) FILTER (kind IN ({strong})) AS base, string_agg(x, ',' ORDER BY s, o) AS spans FROM kept GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in STRONG)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


OP2_SQL = _sql()
