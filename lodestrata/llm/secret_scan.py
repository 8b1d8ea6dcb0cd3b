"""Secret scans: fixed patterns, and a randomness test battery, as DataFrame expressions only.

Patterns. Each kind's matches are those of its pattern, leftmost and without overlap; matches that are too short are dropped
afterwards. The text between matches (`split`) and the matches (`regexp_extract_all`) come from the same matcher, so the spans
follow from their lengths, in code points.

Battery. Every run of 20 or more characters of the base64 or of the base64url alphabet that mixes letter cases or letters and
digits is a candidate; the patterns' spans are blanked out first, so what stands beside one is still looked at, and an equals sign ends a
run, so that the value behind a name is one of its own. Its encoding is inferred (hexadecimal, base32, base64, base64url), its characters become symbol
values, and three tests look at them: chi-squared uniformity over the encoding's alphabet, Wald-Wolfowitz runs (about the
alphabet's middle, and of letter case and digits), and the lag-1 serial correlation. Runs about the middle and serial correlation must not speak against randomness.
Each test gives a p-value under the opposite hypothesis, that the candidate is text: with the symbol collisions of text, with its rate of
changes between upper case, lower case and digits (capitals before small letters aside), and with its serial correlation. Fisher's method combines the three. Over all
documents the combined p-values go through Benjamini-Hochberg control of the false discovery rate, within strata of encoding and
length, since what a short candidate can show is less. The p-values are binned, and counts per stratum and bin (a table
of fixed size) give the threshold. Discoveries are added as spans of kind `random`.

Short candidates whose letters are as mixed as a random string's (a pangram in camel case, say) can't be told from one.

Defined cases: null and empty texts have no span; texts of any length are read whole; rows that repeat are scanned each, and count
each in the control; an empty table gives no row; other columns are ignored (op7) or pass through (redacted).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, workspace

# The patterns, their least lengths (of group 2 for assign) and their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A kept hexadecimal match is a maximal run, so the least length may stand in the pattern.
SCANNED = {"assign": ASSIGN, "access": ACCESS, "hex": r"[0-9a-f]{16,}"}
#: Runs of either alphabet; of the second only those that the first can't have.
CANDIDATES = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding: pattern, alphabet; of text written in it the sums of squared and cubed symbol shares and the rate at which neighbours are of
#: another class (but for the first followed by the second, as at the start of a capitalised word); the first values of the second and third class.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.10, 0.0100, 0.10, 10, 99),
    "base32": (r"^[A-Z2-7]+$", UPPER + "234567", 0.06, 0.0045, 0.04, 26, 99),
    "base64": (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.05, 0.0035, 0.18, 26, 52),
    "base64url": (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.05, 0.0035, 0.18, 26, 52),
}
#: Serial correlation of text.
TEXT_SERIAL = 0.15
BANDS = (32, 48, 80)
#: Two-sided limit of the runs and serial tests (0.001), rate of false discoveries, bins of a decade of p, last bin.
Z_LIMIT, FDR, BINS, LAST_BIN = 3.29, 0.05, 10, 300
LN10 = 2.302585092994046
REDACTED = "[SECRET]"
SPAN = "struct<start:int,kind:int,end:int>"


def _spans(matches: str, pieces: str, kind: int, keep: Callable[[str], str]) -> str:
    """SQL for the spans of the matches that keep (SQL over a match) accepts."""
    step = f"named_struct('at', a.at + y.gap + length(y.m), 'out', if({keep('y.m')}, array_append(a.out, named_struct('start', a.at + y.gap, 'kind', {kind}, 'end', a.at + y.gap + length(y.m))), a.out))"
    pairs = f"zip_with(slice({pieces}, 1, size({matches})), {matches}, (p, m) -> named_struct('gap', length(p), 'm', m))"
    return f"if(size({matches}) = 0, cast(array() as array<{SPAN}>), aggregate({pairs}, named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)), (a, y) -> {step}).out)"


def _sql(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matched(df: DataFrame, column: str, pattern: str, keep: Callable[[str], str] = lambda m: 'true', text: str = "_text") -> DataFrame:
    """df with a column (a kind's name, or that of a battery's candidates): the spans of a pattern in a text."""
    df = df.withColumn("_m", F.expr(f"regexp_extract_all({text}, {_sql(pattern)}, 0)"))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    return df.withColumn(column, F.expr(_spans("_m", "_p", KINDS.index(column if column in KINDS else "random"), keep))).drop("_m", "_p")


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with _text and the spans of the fixed patterns: arrays assign, access and hex."""
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = _matched(df, "assign", SCANNED["assign"], lambda m: f"length(regexp_extract({m}, {_sql(ASSIGN)}, 2)) >= {LEAST['assign']}")
    df = _matched(df, "access", SCANNED["access"], lambda m: f"length({m}) >= {LEAST['access']}")
    return _matched(df, "hex", SCANNED["hex"])


def log10_tail(z: Column) -> Column:
    """-log10 of the standard normal's lower tail at z, for z <= 0 (a published rational approximation); 0 above."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, F.lit(0.0)).otherwise((z * z / 2 + 0.9189385332046727) / 2.302585092994046 - F.log10(poly))


def fisher(told: Column) -> Column:
    """-log10 of the combined p-value of three tests whose -log10 p sum up to told (chi-squared with six degrees of freedom)."""
    x = told * LN10
    return (x - F.ln(1 + x + x * x / 2)) / LN10


def tested(docs: DataFrame) -> DataFrame:
    """docs with _random: candidates as structs of start, kind, end, stratum and bin (-1: not random)."""
    step = "named_struct('at', greatest(a.at, x.end), 'out', concat(a.out, substring(_text, a.at + 1, x.start - a.at), repeat(' ', x.end - greatest(a.at, x.start))))"
    masked = F.expr(f"aggregate(array_sort(concat(assign, access, hex)), named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring(_text, a.at + 1)))")
    df = docs.withColumn("_masked", F.when(F.size("assign") + F.size("access") + F.size("hex") > 0, masked).otherwise(F.col("_text")))
    df = _matched(_matched(df, "_a", CANDIDATES[0], text="_masked"), "_b", CANDIDATES[1], text="_masked")
    told = lambda name: F.transform(name, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), F.substring(F.col("_masked"), c["start"] + 1, c["end"] - c["start"]).alias("s")))
    mixed = lambda c: (c["s"].rlike("[0-9]") & c["s"].rlike("[A-Za-z]")) | (c["s"].rlike("[a-z]") & c["s"].rlike("[A-Z]"))
    df = df.withColumn("_random", F.filter(F.concat(told("_a"), F.filter(told("_b"), lambda c: c["s"].rlike("[_-]"))), mixed)).drop("_a", "_b", "_masked")

    def chosen(c: Column, what) -> Column:
        out = F.lit(None)
        for code, x in reversed(ENCODINGS.items()):
            out = F.when(c["s"].rlike(x[0]), F.lit(what(code, x))).otherwise(out)
        return out

    fields = ("start", "kind", "end")
    own = lambda c, *more: F.struct(*(c[x].alias(x) for x in fields), *more)
    df = df.withColumn("_random", F.filter(F.transform("_random", lambda c: own(
        c,
        F.when(c["s"].rlike(ENCODINGS["hex"][0]), F.lower(c["s"])).otherwise(c["s"]).alias("s"),
        chosen(c, lambda code, x: x[1]).alias("alphabet"),
        chosen(c, lambda code, x: list(ENCODINGS).index(code)).alias("code"),
        chosen(c, lambda code, x: x[2]).alias("p2"),
        chosen(c, lambda code, x: x[3]).alias("p3"),
        chosen(c, lambda code, x: x[4]).alias("rate"),
        chosen(c, lambda code, x: x[5]).alias("c1"),
        chosen(c, lambda code, x: x[6]).alias("c2"),
    )), lambda c: c["code"].isNotNull()))
    df = df.withColumn("_random", F.transform("_random", lambda c: own(
        c, c["code"].alias("code"), c["p2"].alias("p2"), c["p3"].alias("p3"), c["rate"].alias("rate"), c["c1"].alias("c1"), c["c2"].alias("c2"), F.length(c["alphabet"]).cast("double").alias("k"), F.length(c["s"]).cast("double").alias("n"),
        F.transform(F.split(c["s"], ""), lambda x: (F.instr(c["alphabet"], x) - 1).cast("double")).alias("v"),
        F.aggregate(F.split(c["alphabet"], ""), F.lit(0.0), lambda a, x: a + F.pow((F.length(c["s"]) - F.length(F.replace(c["s"], x, F.lit("")))).cast("double"), F.lit(2.0))).alias("squares"),
    )))

    def later(c: Column, f) -> Column:
        """Sum of f over neighbours."""
        size = F.size(c["v"]) - 1
        return F.aggregate(F.zip_with(F.slice(c["v"], 1, size), F.slice(c["v"], 2, size), f), F.lit(0.0), lambda a, x: a + x)

    middle = lambda c: (c["k"] - 1) / 2
    kind_of = lambda c, x: (x >= c["c1"]).cast("int") + (x >= c["c2"]).cast("int")
    df = df.withColumn("_random", F.transform("_random", lambda c: own(
        c, c["code"].alias("code"), c["p2"].alias("p2"), c["p3"].alias("p3"), c["rate"].alias("rate"), c["k"].alias("k"), c["n"].alias("n"), c["squares"].alias("squares"),
        later(c, lambda x, y: F.when((kind_of(c, x) != kind_of(c, y)) & ((x >= c["c1"]) | (y >= c["c2"])), 1.0).otherwise(0.0)).alias("changes"),
        F.aggregate(c["v"], F.lit(0.0), lambda a, x: a + F.when(x > middle(c), 1.0).otherwise(0.0)).alias("above"),
        (1 + later(c, lambda x, y: F.when((x > middle(c)) != (y > middle(c)), 1.0).otherwise(0.0))).alias("runs"),
        later(c, lambda x, y: (x - middle(c)) * (y - middle(c))).alias("products"),
        F.aggregate(c["v"], F.lit(0.0), lambda a, x: a + F.pow(x - middle(c), F.lit(2.0))).alias("mass"),
    )))

    def judged(c: Column) -> Column:
        n, k = c["n"], c["k"]
        expected = 2 * c["above"] * (n - c["above"]) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = (c["runs"] - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
        serial = F.sqrt(n) * (c["products"] / F.greatest(c["mass"], F.lit(1e-9)) + 1 / n)
        square = k / n * c["squares"] - n
        mean = k * (1 + (n - 1) * c["p2"]) - n
        sd = k / n * F.sqrt(2 * n * (n - 1) * (c["p2"] + 2 * (n - 2) * c["p3"] - (2 * n - 3) * c["p2"] * c["p2"]))
        random = (F.abs(runs) <= Z_LIMIT) & (F.abs(serial) <= Z_LIMIT)
        changed = ((n - 1) * c["rate"] - c["changes"]) / F.sqrt((n - 1) * c["rate"] * (1 - c["rate"]))
        even = F.sqrt(n) * (c["products"] / F.greatest(c["mass"], F.lit(1e-9)) - TEXT_SERIAL)
        own_bin = F.least(F.floor(BINS * fisher(log10_tail((square - mean) / sd) + log10_tail(changed) + log10_tail(even))), F.lit(LAST_BIN)).cast("int")
        band = sum(((n >= b).cast("int") for b in BANDS), F.lit(0))
        return F.struct(*(c[x].alias(x) for x in fields), (c["code"] * (len(BANDS) + 1) + band).alias("stratum"), F.when(random, own_bin).otherwise(-1).alias("bin"))

    return df.withColumn("_random", F.transform("_random", judged))


def thresholds(rows: DataFrame, rate: float = FDR) -> dict[int, int]:
    """Least bin of each stratum that Benjamini-Hochberg control discovers; at most strata x bins rows reach the driver."""
    counts = rows.select(F.explode("_random").alias("c")).groupBy("c.stratum", "c.bin").count().collect()
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in counts}:
        own = {r["bin"]: r["count"] for r in counts if r["stratum"] == stratum}
        total, seen = sum(own.values()), 0
        for b in sorted((b for b in own if b > 0), reverse=True):
            seen += own[b]
            if 10 ** (-b / BINS) <= rate * seen / total:
                out[stratum] = b
    return out


def scanned(docs: DataFrame, folder: str, keep: list[str]) -> DataFrame:
    """keep, the base arrays (assign, access, hex) and found: all spans by start and kind. The battery's part is controlled over all of docs."""
    rows = stored(tested(base_spans(docs)).select(*keep, "assign", "access", "hex", "_random"), f"{folder}/spans")
    least = thresholds(rows)
    limit = F.lit(LAST_BIN + 1)
    hit = lambda c: c["bin"] >= F.coalesce(*(F.when(c["stratum"] == s, F.lit(b)) for s, b in sorted(least.items())), limit)
    added = F.transform(F.filter("_random", hit), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return rows.select(*keep, "assign", "access", "hex", F.array_sort(F.concat("assign", "access", "hex", added)).alias("found"))


def _told(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")


def redacted(docs: DataFrame, folder: str) -> DataFrame:
    """docs with every found span of text replaced; all other columns and rows stay, whatever their names."""
    held = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*held).withColumn("text", F.col(held[docs.columns.index("text")]))
    step = "named_struct('at', greatest(a.at, x.end), 'out', if(x.start >= a.at, concat(a.out, substring(text, a.at + 1, x.start - a.at), '" + REDACTED + "'), a.out))"
    cut = F.expr(f"aggregate(found, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring(text, a.at + 1)))")
    text = F.when(F.size("found") > 0, cut).otherwise(F.col("text"))
    return scanned(inner, folder, [*held, "text"]).select(*((text if c == "text" else F.col(h)).alias(c) for c, h in zip(docs.columns, held, strict=True)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts by kind, digest of the patterns' spans, all spans."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned(docs, workspace(spark, "secrets"), ["doc_id"]).select("doc_id", *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"))


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL; doc_id has to be a key there."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = list(KINDS)
    pats = {"assign": ASSIGN, "access": ACCESS, "hex": SCANNED["hex"]}
    code = "CASE " + " ".join(f"WHEN regexp_matches(s, {q(x[0])}) THEN {i}" for i, x in enumerate(ENCODINGS.values())) + " END"
    pick = lambda k: "CASE code " + " ".join(f"WHEN {i} THEN {q(x[k]) if isinstance(x[k], str) else x[k]}" for i, x in enumerate(ENCODINGS.values())) + " END"
    one = lambda kind: f"SELECT doc_id, {q(kind)} AS kind, {kinds.index(kind)} AS ord, regexp_extract_all(x, {q(pats[kind])}) AS ms, string_split_regex(x, {q(pats[kind])}) AS ps FROM t"
    run = lambda k: f"SELECT doc_id, {k} AS half, regexp_extract_all(x, {q(CANDIDATES[k])}) AS ms, string_split_regex(x, {q(CANDIDATES[k])}) AS ps FROM masked"
    tail = lambda z: f"CASE WHEN {z} >= 0 THEN 0 ELSE ({z} * {z} / 2 + 0.9189385332046727) / 2.302585092994046 - log10((1 / (1 + 0.2316419 * abs({z}))) * (0.319381530 + (1 / (1 + 0.2316419 * abs({z}))) * (-0.356563782 + (1 / (1 + 0.2316419 * abs({z}))) * (1.781477937 + (1 / (1 + 0.2316419 * abs({z}))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs({z}))) * 1.330274429))))) END"
    return f"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS x FROM documents),
m AS ({' UNION ALL '.join(map(one, kinds[:3]))}),
u AS (SELECT doc_id, kind, ord, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
v AS (SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM u),
spans AS (SELECT doc_id, kind, ord, e - length(m) AS a, e AS b, m FROM v WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, {q(ASSIGN)}, 2)) >= {LEAST['assign']} WHEN 'access' THEN length(m) >= {LEAST['access']} ELSE true END),
base AS (SELECT doc_id, kind, ord, a, b FROM spans),
marks AS (SELECT doc_id, list({{'a': a, 'b': b}}) AS sp FROM base GROUP BY 1),
masked AS (SELECT t.doc_id, CASE WHEN sp IS NULL THEN x ELSE array_to_string(list_transform(string_split(x, ''), lambda y, i: CASE WHEN len(list_filter(sp, lambda z: z.a < i AND i <= z.b)) > 0 THEN ' ' ELSE y END), '') END AS x FROM t LEFT JOIN marks USING (doc_id)),
rm AS ({' UNION ALL '.join(map(run, (0, 1)))}),
ru AS (SELECT doc_id, half, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(range(1, len(ms) + 1)) AS i FROM rm WHERE len(ms) > 0),
rv AS (SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, half ORDER BY i) AS BIGINT) AS e FROM ru),
c0 AS (SELECT doc_id, e - length(m) AS a, e AS b, m AS s FROM rv WHERE half = 0 OR regexp_matches(m, '[_-]')),
c1 AS (SELECT *, {code} AS code FROM c0 WHERE ((regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')) OR (regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]')))),
c2 AS (SELECT doc_id, a, b, code, CASE WHEN code = 0 THEN lower(s) ELSE s END AS s, {pick(1)} AS alphabet, CAST({pick(2)} AS DOUBLE) AS p2, CAST({pick(3)} AS DOUBLE) AS p3, CAST({pick(4)} AS DOUBLE) AS rate, {pick(5)} AS k1, {pick(6)} AS k2 FROM c1 WHERE code IS NOT NULL),
c3 AS (SELECT *, CAST(length(alphabet) AS DOUBLE) AS k, CAST(length(s) AS DOUBLE) AS n, list_transform(string_split(s, ''), lambda y: CAST(instr(alphabet, y) - 1 AS DOUBLE)) AS v,
  list_sum(list_transform(string_split(alphabet, ''), lambda y: pow(length(s) - length(replace(s, y, '')), 2))) AS squares FROM c2),
c4 AS (SELECT *, (k - 1) / 2 AS mid FROM c3),
c5 AS (SELECT *, CAST(len(list_filter(v, lambda y: y > mid)) AS DOUBLE) AS above,
  1 + list_sum(list_transform(range(1, len(v)), lambda i: CASE WHEN (v[i] > mid) <> (v[i + 1] > mid) THEN 1.0 ELSE 0.0 END)) AS runs,
  list_sum(list_transform(range(1, len(v)), lambda i: CASE WHEN CAST(v[i] >= k1 AS INT) + CAST(v[i] >= k2 AS INT) <> CAST(v[i + 1] >= k1 AS INT) + CAST(v[i + 1] >= k2 AS INT) AND (v[i] >= k1 OR v[i + 1] >= k2) THEN 1.0 ELSE 0.0 END)) AS changes,
  list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - mid) * (v[i + 1] - mid))) AS products, list_sum(list_transform(v, lambda y: pow(y - mid, 2))) AS mass FROM c4),
c6 AS (SELECT *, 2 * above * (n - above) / n + 1 AS expected, k / n * squares - n AS square, k * (1 + (n - 1) * p2) - n AS mean,
  k / n * sqrt(2 * n * (n - 1) * (p2 + 2 * (n - 2) * p3 - (2 * n - 3) * p2 * p2)) AS sd, code * {len(BANDS) + 1} + {' + '.join(f'CAST(n >= {b} AS INT)' for b in BANDS)} AS stratum FROM c5),
c7 AS (SELECT *, (runs - expected) / sqrt(greatest((expected - 1) * (expected - 2) / (n - 1), 1e-9)) AS zr, sqrt(n) * (products / greatest(mass, 1e-9) + 1 / n) AS zs, (square - mean) / sd AS z1,
  ((n - 1) * rate - changes) / sqrt((n - 1) * rate * (1 - rate)) AS z2, sqrt(n) * (products / greatest(mass, 1e-9) - {TEXT_SERIAL}) AS z3 FROM c6),
c7b AS (SELECT *, ({tail('z1')} + {tail('z2')} + {tail('z3')}) * {LN10} AS y FROM c7),
c8 AS (SELECT doc_id, a, b, stratum, CASE WHEN abs(zr) <= {Z_LIMIT} AND abs(zs) <= {Z_LIMIT} THEN least(CAST(floor({BINS} * ((y - ln(1 + y + y * y / 2)) / {LN10})) AS INT), {LAST_BIN}) ELSE -1 END AS bin FROM c7b),
h AS (SELECT stratum, bin, count(*) AS n FROM c8 GROUP BY 1, 2),
r AS (SELECT stratum, bin, sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS seen, sum(n) OVER (PARTITION BY stratum) AS total FROM h),
least_bin AS (SELECT stratum, min(bin) AS bin FROM r WHERE bin > 0 AND pow(10, -bin / {float(BINS)}) <= {FDR} * seen / total GROUP BY 1),
found AS (SELECT doc_id, kind, ord, a, b FROM base UNION ALL SELECT doc_id, 'random', 3, a, b FROM c8 JOIN least_bin l USING (stratum) WHERE c8.bin >= l.bin),
told AS (SELECT doc_id, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, ord, b) AS spans, coalesce(string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, ord, b) FILTER (kind <> 'random'), '') AS own,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM found GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN told USING (doc_id)
"""
