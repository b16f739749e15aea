"""URL verdicts: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is a column expression. Host and path are cut from the URL; a rule fits its host and all
subdomains where the path starts with the rule's, and the longest rule wins. URLs that no rule fits get the
verdict of a model: character n-grams of host and path are hashed by sums of code points into buckets, each weighs the
root of one over their number, and the weights come from a small labelled table of URLs by gradient steps on the
mean loss. A step is one aggregation of the labelled rows; the weights, BUCKETS numbers, go back into the plan as one constant.

Scoring is a projection: no shuffle, no join, and no row depends on another, so a hot host costs what others do.
Null URLs and those without `://` have an empty host and path; without n-grams a score is the model's offset. Weights are
rounded after each step, so that the order of sums doesn't show. Labelled rows without a URL or with another label than 0
and 1 are left out, repeated ones count again, and an empty table gives a score of 0.5, which is blocked only above 0.5.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import table, written

NGRAMS, BUCKETS, STEPS, RATE, MOMENTUM, DECAY, MOST_LABELLED, MOST_RULES = (3, 4), 8192, 25, 4.0, 0.8, 1e-3, 100_000, 1000
#: Multipliers of the code points of an n-gram, primes; and what sets the hashes of paths apart from those of hosts.
PRIMES, PATH = (7919, 104_729, 611_953, 1_299_709), 2053
#: Host, path and verdict of each rule.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Names of the labelled table that the query learns from, made up for it.
UNWANTED = """
casino casino-royal win-casino mega-casino slots-casino free-bets bets4you online-bets bet-win poker-win free-poker jackpot-slots cheap-viagra cheap-pills-online pills-shop diet-pills buy-pills cheap-meds
cheap-watches replica-watches adult-cams adult-movies sexy-adult adult-dating xxx-videos hot-xxx porn-tube porn-free spam-links spamfarm bulk-spam link-farm content-farm click-farm ads-server popup-ads
ads-network my-ads track-ads tracker tracking-pixel click-track free-prizes win-iphone free-money win-cash payday-loan quick-loan free-ringtones warez-crack keygen-free hacked-games fake-shop lottery-win
""".split()
WANTED = """
harbour sailing townhall valley-news library museum compiler-docs gardeners weather school orchestra kitchen cyclists physics railway letters mountains teachers theatre bakery observatory choir
woodwork ships thinker thermal-baths rhetoric northern-tales hospital court botany father brother weather-station other-worlds mathematics thorough thistle pathway earth-science rather-good another-blog
tension nation-history station-house mention fashion lantern painting reading evening-post winter-sports watchmaker freedom-park training ladder-works bettertown adapter reader headland
""".split()
#: What the names stand in, the same for both labels, so that the names alone tell them apart.
FRAMES = "http://{}.example.com/en/12 https://www.{}.example.net/de/345/ http://blog.{}.example.org/fr/6 https://m.{}.example.com/es/789.html http://{}.example.net/en/71#top https://{}.example.org/de/208?page=2".split()


def host_of(url: Column) -> Column:
    """What lies behind the first :// up to / ? # or the end, A-Z in lower case; empty without a ://."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Rules: (host, path, verdict), MOST_RULES at most."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest], F.lit(None).cast("struct<rule:string,verdict:string>"))


def _with(value: Column, use) -> Column:
    """use(value), the value being made once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _times(p: int):
    return lambda c: c * p


def _grams(text: Column, salt: int) -> Column:
    """Buckets of the n-grams of a text between its ends."""
    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))

    def of(codes: Column, n: int) -> Column:
        many = F.greatest(F.size(codes) - (n - 1), F.lit(0))
        total = F.transform(F.slice(codes, 1, many), lambda c: c * PRIMES[0] + salt * n)
        for j in range(1, n):
            total = F.zip_with(total, F.transform(F.slice(codes, j + 1, many), _times(PRIMES[j])), lambda a, b: a + b)
        return F.transform(total, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))

    return F.when(F.length(text) > 0, _with(codes, lambda c: F.concat(*[of(c, n) for n in NGRAMS]))).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column) -> Column:
    """Buckets of all n-grams, repeated ones again."""
    return F.concat(_grams(host, 1), _grams(path, PATH))


@dataclass
class Model:
    weights: list[float]
    offset: float

    def margin(self, grams: Column) -> Column:
        """Log odds of label 1, from buckets as features() gives them."""
        known = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")  # one constant
        mean = lambda g: F.try_divide(F.aggregate(g, F.lit(0.0), lambda z, b: z + F.get(known, b)), F.sqrt(F.size(g).cast("double")))
        return F.lit(self.offset) + F.coalesce(_with(grams, mean), F.lit(0.0))


def train(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, momentum: float = MOMENTUM, decay: float = DECAY) -> Model:
    """A model from (url, label) rows, label 1 for what is to be blocked; more than MOST_LABELLED rows are refused.

    A step goes on with a share of the one before and adds the mean gradient over all rows; weights decay, the offset doesn't.
    """
    rows = labelled.where("url is not null and label in (0, 1)").select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"), F.col("label").cast("double").alias("y"))
    rows, model, last = written(rows, "labelled-urls"), Model([0.0] * BUCKETS, 0.0), [0.0] * (BUCKETS + 1)
    n = rows.count()
    if n > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    rows = rows.coalesce(1 + n // 5000)
    for _ in range(steps if n else 0):
        miss = rows.select("grams", (F.col("y") - 1 / (1 + F.exp(-model.margin(F.col("grams"))))).alias("r"))
        each = F.explode(F.concat(F.transform("grams", lambda b: F.struct(b.alias("b"), (F.col("r") / F.sqrt(F.size("grams").cast("double"))).alias("g"))), F.array(F.struct(F.lit(BUCKETS).alias("b"), F.col("r").alias("g")))))
        got = {r.b: r.g for r in miss.select(each.alias("x")).groupBy("x.b").agg(F.sum("x.g").alias("g")).collect()}  # BUCKETS + 1 rows at most
        last = [round(momentum * v + got.get(b, 0.0) / n - decay * w, 9) for b, (v, w) in enumerate(zip(last, [*model.weights, 0.0], strict=True))]
        now = [round(w + rate * v, 9) for w, v in zip([*model.weights, model.offset], last, strict=True)]
        model = Model(now[:-1], now[-1])
    return model


def judged(pages: DataFrame, model: Model, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score (log odds of block); columns of these names are replaced."""
    out = pages.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    out = out.withColumns({"__rule": rule_of(F.col("__host"), F.col("__path"), rules), "score": model.margin(features(F.col("__host"), F.col("__path")))})
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule.rule"), "verdict": verdict}).drop("__host", "__path", "__rule")


def labelled_rows() -> list[tuple[str, int]]:
    """Each name of the fixed lists in two of the frames."""
    return [(FRAMES[(i + k) % len(FRAMES)].format(name), y) for names, y in ((UNWANTED, 1), (WANTED, 0)) for i, name in enumerate(names) for k in (0, 3)]


def labelled_urls(spark) -> DataFrame:
    """The table that the query learns from."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def op11_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")


def _op11_sql() -> str:
    """Rules, hashes and gradient steps spelled out."""
    cut = "SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest"
    parts = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"

    def grams(text: str, salt: int) -> str:
        of = lambda n: f"list_transform(range(1, greatest(1, length({text}) + 4 - {n})), lambda i: ({' + '.join(f'unicode(({text!s}_)[i + {j}]) * {PRIMES[j]}' for j in range(n))} + {salt * n}) % {BUCKETS})".replace(f"({text}_)", f"('^' || {text} || '$')")
        return f"CASE WHEN length({text}) > 0 THEN list_concat({', '.join(of(n) for n in NGRAMS)}) ELSE [] END"

    both = f"list_concat({grams('host', 1)}, {grams('path', PATH)})"
    rows = ", ".join(f"('{u}', {y})" for u, y in labelled_rows())
    n, steps = len(labelled_rows()), []
    for i in range(STEPS):
        steps.append(f"""z{i} AS MATERIALIZED (SELECT k, any_value(y) - 1 / (1 + exp(-(max(w{i}.v) FILTER (w{i}.b = {BUCKETS}) + coalesce(sum(x * w{i}.v) FILTER (w{i}.b < {BUCKETS}), 0)))) AS r FROM f JOIN w{i} USING (b) GROUP BY k),
g{i} AS (SELECT b, sum(x * r) AS g FROM f JOIN z{i} USING (k) GROUP BY b),
w{i + 1} AS MATERIALIZED (SELECT b, round(v + {RATE!r} * m, 9) AS v, m FROM (SELECT b, v, round({MOMENTUM!r} * m + coalesce(g, 0) / {n} - CASE WHEN b = {BUCKETS} THEN 0 ELSE {DECAY!r} * v END, 9) AS m FROM w{i} LEFT JOIN g{i} USING (b)))""")
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    says = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    return f"""WITH labelled AS MATERIALIZED (SELECT row_number() OVER () AS k, {both} AS grams, y FROM (SELECT {parts}, y FROM ({cut} FROM (VALUES {rows}) t(url, y)))),
f AS MATERIALIZED (SELECT k, y, unnest(grams) AS b, 1 / sqrt(len(grams)) AS x FROM labelled UNION ALL SELECT k, y, {BUCKETS}, 1 FROM labelled),
w0 AS MATERIALIZED (SELECT b, 0::DOUBLE AS v, 0::DOUBLE AS m FROM range({BUCKETS + 1}) r(b)),
{", ".join(steps)},
p AS MATERIALIZED (SELECT row_number() OVER () AS k, page_id, {parts} FROM ({cut} FROM pages)),
m AS (SELECT k, any_value(n) AS n, sum(v) AS z FROM (SELECT k, len(grams) AS n, unnest(grams) AS b FROM (SELECT k, {both} AS grams FROM p)) JOIN w{STEPS} USING (b) GROUP BY k),
j AS (SELECT page_id, host, path, CASE {fits} END AS rule, (SELECT v FROM w{STEPS} WHERE b = {BUCKETS}) + coalesce(z / sqrt(n), 0) AS score FROM p LEFT JOIN m USING (k))
SELECT page_id, host, path, rule, CASE rule {says} ELSE CASE WHEN score > 0 THEN 'block' ELSE 'allow' END END AS verdict FROM j"""


OP11_SQL = _op11_sql()
